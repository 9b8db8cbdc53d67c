"""Column functions over text: tokens, shingle sketches, marker words, lines and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the near-duplicate sketch and gate.
SHINGLE_WIDTH = 5
SKETCH_SIZE = 50
MIN_TOKENS = 25
MIN_JACCARD = 0.3

# Words that mark unfinished work in a comment.
TODO_WORDS = ("TODO", "FIXME", "XXX")

WHITESPACE = " \t\n\r"
_WORD = r"[\p{L}\p{N}_]"
_SPLIT = "[ \\t\\n\\r]+"
# The digit is looked for first, as it is rarer than the end of a word.
_NUMBER_TOKEN = r"(?=[0-9])(?<![^ \t\n\r])[0-9]++(?:\.[0-9]++)?+(?![^ \t\n\r])"


def text_tokens(text: Column) -> Column:
    """Whitespace tokens of plain text; a token that is a number becomes ``0``."""
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    tokens = F.split(F.regexp_replace(trimmed, _NUMBER_TOKEN, "0"), _SPLIT)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(tokens)


def sketch(tokens: Column) -> Column:
    """Bottom-k sketch of the token shingles: the smallest ``SKETCH_SIZE`` hashes, cut before distinct.

    Null when the unit has fewer than ``MIN_TOKENS`` tokens. ``tokens`` must be a stored column: the expression
    inside the lambda runs once per shingle.
    """
    starts = F.sequence(F.lit(1), F.size(tokens) - (SHINGLE_WIDTH - 1))
    hashes = F.transform(starts, lambda i: F.md5(F.array_join(F.slice(tokens, i, SHINGLE_WIDTH), " ")))
    smallest = F.slice(F.sort_array(hashes), 1, SKETCH_SIZE)
    return F.when(F.size(tokens) >= MIN_TOKENS, F.array_distinct(smallest))


def has_marker(text: Column, words=TODO_WORDS) -> Column:
    """True where ``text`` holds one of ``words`` as a whole word, in any case; letters and digits of any script bound it."""
    return F.regexp_like(text, F.lit(rf"(?iu)(?<!{_WORD})(?:{'|'.join(words)})(?!{_WORD})"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_count(text: Column) -> Column:
    """Number of newline-separated lines, without building the array."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def line_range(text: Column, first: Column, last: Column) -> Column:
    """The 1-based, inclusive line range ``first..last`` of ``text``."""
    return F.array_join(F.slice(lines_of(text), first, last - first + 1), "\n")


def path_parts(path: Column) -> Column:
    """Components of an absolute path: ``/a/b`` gives ``a``, ``b``."""
    return F.split(F.ltrim(path, F.lit("/")), "/")


def path_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_parent(path: Column) -> Column:
    """Parent folder of an absolute path; ``/`` is the parent of ``/a``."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def path_ancestors(path: Column) -> Column:
    """All proper ancestor folders of an absolute path, outermost first, beginning with ``/``."""
    parts = path_parts(path)
    deeper = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")),
    )
    top = F.array(F.lit("/"))
    return F.when(F.size(parts) > 1, F.concat(top, deeper)).otherwise(top)


def url_path(url: Column) -> Column:
    """A URL as an absolute path ``/host/…``, without scheme, query, fragment and trailing slashes."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", "/"), "[?#].*$", "")
    return F.rtrim(bare, F.lit("/"))


def qualified_name(owner: Column, name: Column) -> Column:
    """``owner.name``, or just ``name`` where there is no owner."""
    return F.concat_ws(".", owner, name)


def name_or_fallback(qualname: Column, name: Column) -> Column:
    """``qualname`` unless it is empty or null."""
    return F.coalesce(F.nullif(qualname, F.lit("")), name)


def label_text(metric: Column) -> Column:
    return F.replace(metric, F.lit("_"), F.lit(" "))

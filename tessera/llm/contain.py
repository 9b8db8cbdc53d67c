"""Benchmark decontamination by a prefix-filtered set join of word shingles.

An item's windows and the documents are sets of shingles at positions. Shingles are ordered by rarity in the documents;
a document that holds a whole window holds the window's rarest shingle, which is all of the prefix that a containment
of 100 % needs. Only these are joined. A window with a shingle that no document has is out before, a place where the
window would reach over the text's ends is out by its position and length, and what is left is compared word by word.
Native DataFrame operations throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, over_cores
from tessera.operators.skew import lookup_join
from tessera.session import stage

# Fixed value: what stands between words; A-Z are lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 5
#: Item shingles that are broadcast at a time, 8 bytes each; more of them make more scans.
BLOCK_ROWS = 4_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _shingles(words: Column, width: int) -> Column:
    """Hashes of the ``width`` consecutive words from each place on. The outer lambda names the word hashes."""
    def at_each(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - width)
        return F.when(F.size(h) >= width, F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])))

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), at_each)[0]


def item_windows(items: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """``item, window, len``: each distinct window of an item, its words joined by blanks."""
    worded = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window, F.lit(0)) + 1)
    cut = F.transform(starts, lambda s: F.array_join(F.slice("w", s, window), " "))
    rows = worded.filter(F.size("w") > 0).select("item", F.explode(cut).alias("window"), F.least(F.size("w"), F.lit(window)).alias("len"))
    return rows.distinct()


def _matches(docs: DataFrame, hashes: DataFrame, width: int, window: int) -> DataFrame:
    """Places of ``docs(k, t, words)`` whose shingle is in ``hashes``, with the words that a window there may reach.

    ``hashes`` has at most a block's rows and is broadcast; only what matches leaves the task.
    """
    n, low = F.size("words"), F.greatest(F.col("at") - (window - width), F.lit(0))
    places = docs.select("k", "t", "words", F.posexplode(_shingles(F.col("words"), width)).alias("at", "h"))
    return places.join(F.broadcast(hashes), "h").select(
        "k", "t", "h", n.alias("n"), "at", low.alias("low"), F.slice("words", low + 1, 2 * window - width).alias("near")
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``<key>, n_words, hits, items`` of each row of ``docs``.

    ``hits`` are the word places (from 0, ascending, each once) inside an occurrence of an item's window, ``items`` the
    ids, as strings in order, of the items with such windows. A null or empty text has no words and no hits; an item
    without words is in no document. Rows that repeat, or share a null key, each get their row; items that share an id
    are one item, a null id is an empty string. Empty tables work. Columns other than these four are not read.

    Documents are told apart by key and text hash until the end. What is exploded is one 8-byte hash a word; it meets
    the distinct item shingles, at most ``block_rows`` of them in a scan, and only places that match are staged, with the
    few words around them that the comparison needs: texts are not shuffled. A passage that stands in a third of all
    documents is split over tasks (``lookup_join``) where it meets its windows.
    """
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    owned = stage(item_windows(items, item_key, item_text, window), "item-windows")
    windows = owned.select("window", "len").distinct()
    widths = sorted(r[0] for r in windows.select(F.least("len", F.lit(shingle)).alias("width")).distinct().collect())
    if not widths:
        return rows.select(
            F.col("k").alias(key), F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
            F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"),
        )
    parts = [
        windows.filter(F.least("len", F.lit(shingle)) == width)
        .select("window", "len", F.posexplode(_shingles(F.split("window", " "), width)).alias("offset", "h"))
        for width in widths
    ]
    pieces = stage(reduce(DataFrame.unionAll, parts), "window-shingles")
    # Rows that repeat in key and text have the same places; what follows keeps one of each.
    hashes = stage(pieces.select("h").distinct(), "item-shingles")
    blocks = hashes.count() // block_rows + 1
    worded = over_cores(rows, "t").select("k", "t", words_of(F.col("text")).alias("words"))
    found = [
        _matches(worded, hashes.filter(F.pmod("h", F.lit(blocks)) == block), width, window)
        for block in range(blocks) for width in widths
    ]
    seen = stage(reduce(DataFrame.unionAll, found), "seen-shingles")
    rarity = stage(seen.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "shingle-rarity")
    ranked = pieces.join(rarity, "h", "left").groupBy("window", "len").agg(
        F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min(F.struct("df", "h", "offset")).alias("rarest")
    )
    prefix = stage(ranked.filter("least > 0").select("window", "len", "rarest.h", "rarest.offset", "rarest.df"), "window-prefixes")
    weights = stage(prefix.groupBy("h").agg(F.max("df").alias("df"), F.collect_list(F.struct("window", "len", "offset")).alias("windows")), "prefix-windows")
    met = lookup_join(seen, weights, ["h"], "df", "t").select("k", "t", "n", "at", "low", "near", F.explode("windows").alias("of"))
    start = F.col("at") - F.col("of.offset")
    fits = met.select("k", "t", "n", "low", "near", start.alias("start"), "of.window", "of.len").filter(
        (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))
    )
    same = F.array_join(F.slice("near", F.col("start") - F.col("low") + 1, F.col("len")), " ") == F.col("window")
    verified = stage(fits.filter(same).select("k", "t", "start", "len", "window").distinct(), "verified-windows")
    spans = verified.groupBy("k", "t").agg(F.collect_set(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("spans"))
    spans = spans.select("k", "t", F.array_sort(F.array_distinct(F.flatten("spans"))).alias("hits"))
    uses = stage(verified.select("k", "t", "window").distinct(), "window-uses")
    owners = owned.groupBy("window").agg(F.collect_set("item").alias("owners"))
    weighed = stage(uses.groupBy("window").agg(F.count(F.lit(1)).alias("uses")).join(owners, "window"), "window-owners")
    held = lookup_join(uses, weighed, ["window"], "uses", "t").groupBy("k", "t").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items")
    )
    found = stage(spans.alias("s").join(held.alias("i"), F.expr("s.k <=> i.k AND s.t = i.t")).select("s.k", "s.t", "hits", "items"), "contaminated")
    sized = rows.select("k", "t", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    result = sized.join(found, sized["k"].eqNullSafe(found["k"]) & sized["t"].eqNullSafe(found["t"]), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return result.select(sized["k"].alias(key), "n_words", none("hits", "int"), none("items", "string"))

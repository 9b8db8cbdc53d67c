"""Near-duplicate search over sketches: an exact set-similarity self-join with an argmax per unit.

The join never compares units that share nothing, and never lists the pairs of a group of copies:

* units with one sketch are folded into one row first; only distinct sketches are joined;
* every hash gets its document frequency, hashes seen once are dropped, and each sketch is ordered rarest first;
* a pair at or above the gate must share a hash in the prefix of both (Bayardo et al. 2007, Xiao et al. 2008);
* hashes up to ``COLD_MAX`` sketches ("cold") are joined directly: work is linear, at most ``COLD_MAX`` per posting;
* for a pair whose rarest common hash is hotter, all it shares is hot. Such sketches are folded again by their hot
  part and size ("profile"), since members of one profile are equal for that purpose.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.shingles import with_sketches, with_text_sketches
from tessera.functions.text import MIN_JACCARD, MIN_TOKENS, name_or_fallback
from tessera.operators.skew import lookup_join, paired_members, row_numbers
from tessera.session import discard, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLD_MAX = 256
#: Profiles or sketches on each side of a cell of comparisons, and hashes that it compares at once.
BLOCK_ROWS, CELL_HASHES = 1_000, 1_024


@dataclass(frozen=True)
class SketchIndex:
    """Staged tables of one corpus; all of them are linear in the number of units."""

    units: DataFrame  # key, n_tokens, n
    members: DataFrame  # key, rep, copies: which distinct sketch (named by its smallest key) a unit has
    seconds: DataFrame  # rep, second: second smallest key of a sketch that occurs more than once
    ranked: DataFrame  # sid, n, copies, shared (hash ids, rarest first), n_cold, n_prefix
    profiles: DataFrame  # sid, n, copies, hot, cold: the sketches with enough hot hashes to match on those alone

    @cached_property
    def cold_links(self) -> DataFrame:
        """``a, b, jaccard`` of ``cold_pairs``, staged once for all who look for partners."""
        return stage(cold_pairs(self).select("a", "b", "jaccard"), "cold-pairs")


def sketch_units(units: DataFrame) -> DataFrame:
    """``key, tokens`` to ``key, n_tokens, n, digest, fp``; units that are too small have a null sketch.

    Units may also come as ``key, text``: a plain text is cut into tokens where it is hashed, so that no list of tokens
    is made and handed over. Staged, since a filter on the sketch would otherwise be pushed below it and compute it twice.
    """
    if "text" in units.columns:
        no_tokens = F.array().cast("array<string>")
        schema = units.select("key", F.length("text").alias("n_tokens"), F.when(F.col("text").isNotNull(), no_tokens).alias("fp")).schema
        sketched = units.select("key", "text").mapInArrow(with_text_sketches, schema)
    else:
        n_tokens = F.size("tokens")
        usable = units.select("key", n_tokens.alias("n_tokens"), F.when(n_tokens >= MIN_TOKENS, F.col("tokens")).alias("tokens"))
        schema = usable.select("key", "n_tokens", F.col("tokens").alias("fp")).schema
        sketched = usable.mapInArrow(with_sketches, schema)
    return stage(
        sketched.select(
            "key",
            "n_tokens",
            F.coalesce(F.size("fp"), F.lit(0)).alias("n"),
            F.sha2(F.array_join("fp", "").cast("binary"), 256).alias("digest"),
            "fp",
        ),
        "sketches",
    )


def fold_copies(rows: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """Group rows ``key, <digest>`` by digest: ``(key, <digest>, rep, last, copies)`` and ``(rep, second)``.

    ``rep`` and ``last`` are the smallest and largest key, ``second`` the smallest after ``rep``. The groups come from
    map-side minima, so a group of copies of any size costs one row per task.
    """
    groups = stage(
        rows.groupBy(digest).agg(
            F.min("key").alias("rep"), F.max("key").alias("last"), F.count(F.lit(1)).alias("copies")
        ),
        "copies",
    )
    members = stage(lookup_join(rows.select("key", digest), groups, [digest], "copies", "key"), "members")
    seconds = (
        members.filter((F.col("copies") > 1) & (F.col("key") != F.col("rep")))
        .groupBy("rep")
        .agg(F.min("key").alias("second"))
    )
    return members, stage(seconds, "seconds")


def _needed(n: Column) -> Column:
    """Fewest common hashes a sketch of size ``n`` needs to reach the gate: ``ceil(0.3 * n)`` in whole numbers."""
    tenths = round(MIN_JACCARD * 10)
    return F.floor((n * tenths + 9) / 10).cast("int")


def build_index(units: DataFrame) -> SketchIndex:
    """Sketch ``units(key, tokens)`` or ``units(key, text)`` and build the tables of the join."""
    sketched = sketch_units(units)
    usable = sketched.filter(F.col("n") > 0)
    members, seconds = fold_copies(usable, "digest")
    reps = members.filter(F.col("key") == F.col("rep")).select("key", "copies")
    postings = usable.join(reps, "key", "left_semi").select(F.col("key").alias("sid"), "n", F.explode("fp").alias("hex"))
    postings = stage(postings.select("sid", "n", F.unhex("hex").alias("h")), "postings")  # half the bytes to keep and shuffle
    # A staged id per shared hash: 8 bytes in every later shuffle instead of 32, with no chance of a collision.
    frequency = stage(
        postings.groupBy("h")
        .agg(F.count(F.lit(1)).alias("df"))
        .filter(F.col("df") > 1)
        .withColumn("hid", F.monotonically_increasing_id()),
        "frequency",
    )
    needed = _needed(F.col("n"))
    ranked = (
        lookup_join(postings, frequency, ["h"], "df", "sid")
        .groupBy("sid", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "hid"))).alias("by_df"))  # at most SKETCH_SIZE entries
        .filter(F.size("by_df") >= needed)
        .select(
            "sid",
            "n",
            F.col("by_df.hid").alias("shared"),
            F.size(F.filter("by_df", lambda p: p["df"] <= COLD_MAX)).alias("n_cold"),
            (F.size("by_df") - needed + 1).alias("n_prefix"),
        )
    )
    copies = reps.groupBy(F.col("key").alias("sid")).agg(F.max("copies").alias("copies"))  # a key may repeat
    ranked = stage(ranked.join(copies, "sid"), "ranked")
    kept = stage(sketched.select("key", "n_tokens", "n"), "units")
    discard(sketched, postings, frequency)  # the hashes are in none of the other tables
    hot_size = F.size("shared") - F.col("n_cold")
    profiles = ranked.filter(hot_size >= needed).select(
        "sid", "n", "copies", F.slice("shared", F.col("n_cold") + 1, hot_size).alias("hot"), F.slice("shared", F.lit(1), "n_cold").alias("cold")
    )
    return SketchIndex(kept, members, seconds, ranked, profiles)


def _jaccard(inter: Column, n_a: Column, n_b: Column) -> Column:
    return inter / (n_a + n_b - inter)


def _enough(common: Column, n_a: Column, n_b: Column) -> Column:
    """Whether ``common`` hashes reach the gate: ``common / (n_a + n_b - common) >= 0.3`` in whole numbers."""
    tenths = round(MIN_JACCARD * 10)
    return common * (10 + tenths) >= (n_a + n_b) * tenths


def _gated_overlap(shared_a: Column, shared_b: Column, n_a: Column, n_b: Column, first: Column) -> Column:
    """Number of common hashes if ``first`` is the first of them and the pair passes the gate, else null.

    The lambda only names the intersection, so that it is computed once.
    """
    common = F.array(F.array_intersect(shared_a, shared_b))
    passes = lambda c: (c[0] == first) & _enough(F.size(c), n_a, n_b)
    return F.transform(common, lambda c: F.when(passes(c), F.size(c)))[0]


def _common_counts(lists: pa.ListArray, rows: list[np.ndarray]) -> np.ndarray:
    """How many hashes each row of the first side has in common with each of the second, by incidence matrices."""
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    values, column = np.unique(np.asarray(pc.list_flatten(lists)), return_inverse=True)
    both = np.ones(len(values), bool)  # only hashes that both sides hold need a column
    for side in rows:
        here = np.zeros(len(sizes), bool)
        here[side] = True
        both &= np.bincount(column[here[own]], minlength=len(values)) > 0
    kept = both[column]
    own, column = own[kept], (np.cumsum(both) - 1)[column[kept]]
    common = np.zeros((len(rows[0]), len(rows[1])), np.float32)
    for start in range(0, int(both.sum()), CELL_HASHES):
        part = (column >= start) & (column < start + CELL_HASHES)
        held = np.zeros((len(sizes), CELL_HASHES), np.float32)
        held[own[part], column[part] - start] = 1
        common += held[rows[0]] @ held[rows[1]].T
    return common


def _gated_cell(table: pa.Table) -> tuple[list[np.ndarray], bool, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of both sides, whether there is one side only, and for each pair of rows what the two have in common,
    the sum of their sizes, and whether they pass the gate. With a column ``cold`` they must share nothing of that, and with a column ``asks`` one must ask."""
    side, n = (table.column(c).to_numpy() for c in ("side", "n"))
    rows = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    alone = not len(rows[1])
    if alone:
        rows[1] = rows[0]
    common = _common_counts(table.column("hot").combine_chunks(), rows)
    tenths = round(MIN_JACCARD * 10)
    total = n[rows[0]][:, None] + n[rows[1]][None, :]
    found = (common > 0) & (common * (10 + tenths) >= total * tenths)
    if "asks" in table.column_names:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        found &= asks[rows[0]][:, None] | asks[rows[1]][None, :]
    if "cold" in table.column_names and found.any():
        found &= _common_counts(table.column("cold").combine_chunks(), rows) == 0
    return rows, alone, common, total, found


#: Columns that a pair has of each side, as far as the rows hold them, and what the pair calls them.
_CARRIED = {"pid": ("a", "b"), "n": ("n_a", "n_b"), "copies": ("size_a", "size_b")}


def _pairs_of_cell(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Gated pairs of a cell: rows of side 0 with those of side 1, or with each other if all are on side 0."""
    rows, alone, common, _, found = _gated_cell(table)
    i, j = np.nonzero(np.triu(found, 1) if alone else found)
    carried = table.select([c for c in _CARRIED if c in table.column_names])  # a pair does not repeat the hashes
    a, b = (carried.take(pa.array(r)) for r in (rows[0][i], rows[1][j]))
    columns = [t.column(c) for c in carried.column_names for t in (a, b)]
    return pa.table([*columns, pa.array(common[i, j].astype(np.int32))], schema=schema)


def _in_order(key):
    """A unit's key as Spark orders it: a struct by its fields, nulls first."""
    return tuple((x is not None, x) for x in key.values()) if isinstance(key, dict) else key


def _best_of_cell(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Each row's best gated partner in a cell, the smallest of equal ones: ``pid, score, partner``."""
    rows, alone, common, total, found = _gated_cell(table)
    keys = [_in_order(x) for x in table.column("pid").to_pylist()]
    rank = {key: i for i, key in enumerate(sorted(set(keys)))}
    ranks = np.array([rank[key] for key in keys])
    found &= ranks[rows[0]][:, None] != ranks[rows[1]][None, :]
    score = np.where(found, common.astype(np.float64) / np.maximum(total - common.astype(np.float64), 1), 0.0)
    out = [[], [], []]
    for me, other, values in [(rows[0], rows[1], score), (rows[1], rows[0], score.T)][: 1 if alone else 2]:
        order = np.argsort(ranks[other], kind="stable")
        best = order[values[:, order].argmax(axis=1)]
        reached = values[np.arange(len(me)), best]
        for column, some in zip(out, (me, reached, other[best])):
            column.append(some[reached > 0])
    me, reached, partner = (np.concatenate(column) for column in out)
    pids = table.column("pid")
    return pa.table([pids.take(pa.array(me)), pa.array(reached), pids.take(pa.array(partner))], schema=schema)


def _spans_of_cell(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The spans of blocks ``low`` to ``high`` of the rows that pass the gate, each pair of spans once."""
    rows, _, _, _, found = _gated_cell(table)
    spans = np.stack([table.column(c).to_numpy() for c in ("low", "high")], axis=1)
    distinct, own = np.unique(spans, axis=0, return_inverse=True)
    own = own.reshape(-1)
    met = np.zeros((len(distinct), len(distinct)), bool)
    i, j = np.nonzero(found)
    met[own[rows[0][i]], own[rows[1][j]]] = True
    x, y = np.nonzero(met)
    return pa.table([pa.array(c) for c in (*distinct[x].T, *distinct[y].T)], schema=schema)


def _numbered(rows: DataFrame, last: str, label: str) -> DataFrame:
    """``rows`` with ``block``: neighbours by their hottest hashes, so that rows that are alike have few blocks."""
    order = [F.reverse("hot"), F.col("n"), F.col(last)]
    numbered = row_numbers(rows, [], order, "_place")
    block = F.floor((F.col("_place") - 1) / BLOCK_ROWS).cast("long")
    return stage(numbered.select(*rows.columns, block.alias("block")), label)


def _meeting(posts: DataFrame, numbered: DataFrame) -> DataFrame:
    """Pairs of blocks that hold one of the hashes of ``posts(h, pid)`` both: ``block_x <= block_y``."""
    held = posts.select("h", "pid").join(numbered.select("pid", "block"), "pid").select("h", "block").distinct()
    held = stage(held, "hash-blocks")
    x, y = (held.select("h", F.col("block").alias(f"block_{n}")) for n in "xy")
    return x.join(y, "h").filter("block_x <= block_y").select("block_x", "block_y").distinct()


def _in_cells(numbered: DataFrame, cells: DataFrame):
    """The rows grouped by cell: those of ``block_x`` on side 0, those of another ``block_y`` on side 1.

    Two rows meet in one cell only. Few bytes, much work: a cell or a few to a task, which adaptive coalescing would
    put together.
    """
    cells = stage(cells, "cells")
    sides = [
        numbered.withColumnRenamed("block", f"block_{n}")
        .join(cells.filter("block_x <> block_y") if k else cells, f"block_{n}")
        .withColumn("side", F.lit(k))
        for k, n in enumerate("xy")
    ]
    n, cores = cells.count(), cells.sparkSession.sparkContext.defaultParallelism
    spread = sides[0].unionByName(sides[1]).repartition(max(1, min(n, 4 * cores), n // 16), "block_x", "block_y")
    return spread.groupBy("block_x", "block_y")


def _by_cell(numbered: DataFrame, cells: DataFrame, work, empty: DataFrame) -> DataFrame:
    arrow = to_arrow_schema(empty.schema)
    return _in_cells(numbered, cells).applyInArrow(lambda table: work(table, arrow), empty.schema)


def _gated_pairs(numbered: DataFrame, cells: DataFrame) -> DataFrame:
    """Gated pairs of the rows ``pid, n, hot, block`` in the cells: ``a, b, n_a, n_b, inter``, each once, ``a < b``.

    With a column ``copies`` the pairs also have ``size_a, size_b``.
    """
    named = {c: names for c, names in _CARRIED.items() if c in numbered.columns}
    empty = numbered.select(*[F.col(c).alias(name) for c, names in named.items() for name in names], F.lit(0).alias("inter"))
    met = _by_cell(numbered, cells, _pairs_of_cell, empty).filter(F.col("a") != F.col("b"))
    swap = F.col("a") > F.col("b")
    side = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    return met.select(*[side(x, y) for p, q in named.values() for x, y in ((p, q), (q, p))], "inter")


def _profile_posts(profiles: DataFrame) -> DataFrame:
    """``h, pid, n, hot, at``: the prefix hashes of profiles; a gated pair has one of them in common."""
    prefix = F.slice("hot", F.lit(1), F.size("hot") - _needed(F.col("n")) + 1)
    return profiles.select("pid", "n", "hot", F.posexplode(prefix).alias("at", "h"))


def _profile_overlaps(posts: DataFrame) -> DataFrame:
    """Gated pairs of the profiles that meet in a hash: ``a, b, n_a, n_b, inter``, each once, ``a < b``.

    ``posts`` is ``h, pid, n, hot, at``. A hot hash holds many profiles, which meet again in most of their hashes; so
    all profiles are cut into blocks, and two blocks that share a hash are one comparison, whatever they share.
    """
    numbered = _numbered(posts.filter("at = 0").select("pid", "n", "hot"), "pid", "profile-blocks")
    return _gated_pairs(numbered, _meeting(posts, numbered))


def _hot_pairs(index: SketchIndex) -> DataFrame:
    """Gated pairs of sketches that share hot hashes only: ``a, b, n_a, n_b, size_a, size_b, inter``, each once, ``a < b``.

    Sketches of one profile are neighbours in blocks. The profiles tell which blocks hold a pair that passes the gate;
    only these are compared, sketch by sketch, so no pair of profiles is listed or joined to its members.
    """
    rows = index.profiles.withColumnRenamed("sid", "pid")
    numbered = _numbered(rows, "pid", "sketch-blocks")
    spans = [F.min("block").alias("low"), F.max("block").alias("high")]
    profiles = numbered.groupBy("n", "hot").agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("sketches"), *spans)
    profiles = stage(profiles, "profiles")
    own = {f"{c}_{n}": F.col(c) for n in "ab" for c in ("low", "high")}
    own = [c.alias(name) for name, c in own.items()]
    posts, folded = _profile_posts(profiles), _numbered(profiles, "pid", "profile-blocks")
    met = _by_cell(folded, _meeting(posts, folded), _spans_of_cell, folded.select(*own))
    within = profiles.filter((F.col("sketches") > 1) & _enough(F.size("hot"), F.col("n"), F.col("n"))).select(*own)
    both = stage(met.unionByName(within).distinct(), "block-spans")
    x, y = (F.explode(F.sequence(f"low_{n}", f"high_{n}")).alias(n) for n in "ab")
    cells = both.select(x, "low_b", "high_b").select("a", y)
    cells = cells.select(F.least("a", "b").alias("block_x"), F.greatest("a", "b").alias("block_y")).distinct()
    return _gated_pairs(numbered, cells)


def cold_pairs(index: SketchIndex) -> DataFrame:
    """Gated pairs of distinct sketches that share a cold hash, ``a < b``: ``a, b, n_a, n_b, size_a, size_b, inter, jaccard``.

    A pair is kept only in the join group of its first common hash, so there is nothing to de-duplicate; all it has in
    common lies from there on, and two positions too far back are dropped before the sketches are compared. Where the
    sketches have a column ``asks``, pairs of which none asks are dropped there as well.
    """
    prefix = F.slice("shared", F.lit(1), F.least("n_prefix", "n_cold"))
    asking = "asks" in index.ranked.columns
    own = {"sid": "{}", "n": "n_{}", "copies": "size_{}", "shared": "s_{}"} | ({"asks": "asks_{}"} if asking else {})
    posts = index.ranked.select(*own, F.posexplode(prefix).alias("at", "h"))
    left = F.size("shared") - F.col("at")
    a, b = (posts.select("h", *[F.col(c).alias(own[c].format(n)) for c in own], left.alias(f"left_{n}")) for n in "ab")
    n_a, n_b = F.col("n_a"), F.col("n_b")
    met = a.join(b, "h").filter((F.col("a") < F.col("b")) & _enough(F.least("left_a", "left_b"), n_a, n_b))
    if asking:
        met = met.filter("asks_a or asks_b")
    inter = _gated_overlap(F.col("s_a"), F.col("s_b"), n_a, n_b, F.col("h"))
    pairs = met.select("a", "b", "n_a", "n_b", "size_a", "size_b", inter.alias("inter")).filter(F.col("inter").isNotNull())
    return pairs.withColumn("jaccard", _jaccard(F.col("inter"), n_a, n_b))


def _fold_profiles(index: SketchIndex) -> tuple[DataFrame, DataFrame]:
    """Sketches folded by ``(n, hot)``: profiles ``pid, n, hot, sketches, second`` and members ``sid, pid``."""
    tagged = index.profiles.drop("cold", "copies").withColumn(
        "shape", F.sha2(F.concat_ws(",", F.col("n").cast("string"), F.col("hot").cast("array<string>")), 256)
    )
    tagged = stage(tagged.withColumnRenamed("sid", "key"), "profile-rows")
    rows, seconds = fold_copies(tagged, "shape")
    members = rows.select(F.col("key").alias("sid"), F.col("rep").alias("pid"))
    profiles = stage(
        tagged.join(rows.filter(F.col("key") == F.col("rep")).select("key", "copies"), "key")
        .join(seconds.withColumnRenamed("rep", "key"), "key", "left")
        .select(F.col("key").alias("pid"), "n", "hot", F.col("copies").alias("sketches"), "second"),
        "profiles",
    )
    return profiles, members


def _within_profiles(profiles: DataFrame) -> DataFrame:
    """``pid, inter, jaccard`` of the profiles with at least two members, if these match each other."""
    inter = F.size("hot").alias("inter")
    alike = profiles.filter(F.col("sketches") > 1).select("pid", inter, _jaccard(F.size("hot"), F.col("n"), F.col("n")).alias("jaccard"))
    return alike.filter(F.col("jaccard") >= MIN_JACCARD)


def hot_profiles(index: SketchIndex) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches folded by ``(n, hot)``: profile rows, their members, and the gated profile pairs.

    Profiles are ``pid, n, hot, sketches, second``; members ``sid, pid``; pairs ``ga, gb, inter, jaccard`` with
    ``ga <= gb``, and ``ga = gb`` for a profile with at least two members that match each other.
    """
    profiles, members = _fold_profiles(index)
    met = _profile_overlaps(_profile_posts(profiles))
    across = met.select(
        F.col("a").alias("ga"), F.col("b").alias("gb"), "inter", _jaccard(F.col("inter"), F.col("n_a"), F.col("n_b")).alias("jaccard")
    )
    within = _within_profiles(profiles).select(F.col("pid").alias("ga"), F.col("pid").alias("gb"), "inter", "jaccard")
    return profiles, members, stage(across.union(within), "profile-pairs")


def sketch_pairs(index: SketchIndex) -> DataFrame:
    """All gated pairs of *distinct* sketches: ``a, b, n_a, n_b, inter, uni, jaccard``, each once, ``a < b``.

    With ``index.members`` this names every gated pair of units; the pairs inside a group of copies, and the product
    of two groups, are left folded.
    """
    return _sized_pairs(index).drop("size_a", "size_b")


def _sized_pairs(index: SketchIndex) -> DataFrame:
    """``sketch_pairs`` with ``size_a, size_b``, the numbers of copies; these travel with the sketches, so the pairs,
    of which there are far more, are joined to nothing."""
    pairs = cold_pairs(index)
    if not index.profiles.isEmpty():
        hot = _hot_pairs(index)
        pairs = pairs.unionByName(hot.withColumn("jaccard", _jaccard(F.col("inter"), F.col("n_a"), F.col("n_b"))))
    uni = F.col("n_a") + F.col("n_b") - F.col("inter")
    return pairs.select("a", "b", "n_a", "n_b", "size_a", "size_b", "inter", uni.alias("uni"), "jaccard")


@dataclass(frozen=True)
class PairGroups:
    """All gated pairs of units, factorised: no pair is listed that two groups of copies imply."""

    groups: DataFrame  # group (its smallest key), n, size, n_links: gated partners of each of its members
    members: DataFrame  # key, group, size
    links: DataFrame  # a, b, n_a, n_b, size_a, size_b, inter, uni, jaccard, pairs; a = b for the pairs inside a group


def pair_groups(index: SketchIndex, asked: DataFrame | None = None) -> PairGroups:
    """The complete result of the pair join over units, in space that is linear in units and links of *sketches*.

    Units with one sketch are a group. Each unit of ``a`` pairs with each unit of ``b`` where a link joins the two, and
    with each other unit of its own group; ``pairs`` counts these. Units without a usable sketch are in no group.

    Links may be far more than units, so they are not staged: who needs only their number never writes them. With
    ``asked(key)`` there are only the links of those units' groups, and ``groups`` are these groups.
    """
    sizes = index.members.filter(F.col("key") == F.col("rep")).select("key", F.col("copies").alias("size"))
    sizes = stage(sizes.join(index.units.select("key", "n"), "key").withColumnRenamed("key", "group"), "group-sizes")
    repeated = sizes.groupBy("group").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    if asked is not None:
        chosen = index.members.join(asked.select("key").distinct(), "key", "left_semi").select(F.col("rep").alias("group"))
        chosen = stage(chosen.distinct(), "asked-groups")
        sizes = sizes.join(chosen, "group", "left_semi")
        asks = chosen.select(F.col("group").alias("sid"), F.lit(True).alias("asks"))
        flagged = [
            stage(rows.join(asks, "sid", "left").fillna(False, ["asks"]), "asked-sketches") for rows in (index.ranked, index.profiles)
        ]
        index = replace(index, ranked=flagged[0], profiles=flagged[1])

    sides = ["a", "b", "n_a", "n_b", "size_a", "size_b", "inter", "uni", "jaccard"]
    across = _sized_pairs(index).select(*sides, (F.col("size_a") * F.col("size_b")).alias("pairs"))
    if not repeated.isEmpty():  # a key that stands for several units has a link for each
        for side in "ab":
            across = across.join(repeated.withColumnRenamed("group", side), side, "left")
            across = across.withColumn("_rows", F.explode(F.sequence(F.lit(1), F.coalesce("_rows", F.lit(1))))).drop("_rows")
        across = across.select(*sides, "pairs")
    own = {"a": "group", "b": "group", "size_a": "size", "size_b": "size"} | dict.fromkeys(("n_a", "n_b", "inter", "uni"), "n")
    within = sizes.filter(F.col("size") > 1).select(
        *[F.col(own[c]).alias(c) if c in own else F.lit(1.0).alias(c) for c in sides],
        F.expr("size * (size - 1) div 2").alias("pairs"),
    )
    toward = F.array(*[F.struct(F.col(x).alias("group"), F.col(f"size_{y}").alias("more")) for x, y in ("ab", "ba")])
    reached = across.select(F.explode(toward).alias("x")).groupBy("x.group").agg(F.sum("x.more").alias("more"))
    n_links = F.col("size") - 1 + F.coalesce("more", F.lit(0))
    groups = sizes.join(reached, "group", "left").select("group", "n", "size", n_links.alias("n_links"))
    members = index.members.select("key", F.col("rep").alias("group"), F.col("copies").alias("size"))
    return PairGroups(groups, members, across.unionByName(within))


def partner_counts(found: PairGroups) -> DataFrame:
    """``key, group, size, n_links`` of each unit in a group: how many units it is paired with, none of them listed."""
    counts = stage(found.groups.select("group", "size", "n_links"), "groups")
    return lookup_join(found.members.select("key", "group"), counts, ["group"], "size", "key")


def partners_of(found: PairGroups, asked: DataFrame) -> DataFrame:
    """``key, partner, jaccard``: every gated partner of the units ``asked(key)``, and of no others.

    Only here are links turned into pairs of units. Groups are cut into blocks, the asked units apart from the others,
    so neither a popular group nor many questions to it make a large task. ``found`` may be limited to ``asked``.
    """
    asking = found.members.join(asked.select("key").distinct(), "key", "left_semi")
    side = lambda asks: F.struct(F.lit(asks).alias("asks"), F.col("group")).alias("side")
    rows = asking.select("key", side(True)).unionByName(found.members.select("key", side(False)))
    links = found.links.select("jaccard", F.explode(
        F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
            F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        )
    ).alias("way"))
    ways = links.select(
        F.struct(F.lit(True).alias("asks"), F.col("way.a").alias("group")).alias("ga"),
        F.struct(F.lit(False).alias("asks"), F.col("way.b").alias("group")).alias("gb"), "jaccard",
    )
    wanted = ways.join(asking.select(F.col("group")).distinct(), F.col("ga.group") == F.col("group"), "left_semi")
    met = paired_members(stage(wanted, "asked-links"), stage(rows, "asked-rows"), "side", "key")
    return met.select(F.col("a.key").alias("key"), F.col("b.key").alias("partner"), "jaccard").filter("key <> partner")


def best_partner(candidates: DataFrame, unit: str) -> DataFrame:
    """Argmax per unit with the tie rule: highest score, then smallest partner. Combines map-side."""
    best = F.min(F.struct((-F.col("score")).alias("worse"), F.col("partner")))
    return candidates.groupBy(unit).agg(best.alias("best")).select(
        unit, (-F.col("best.worse")).alias("score"), F.col("best.partner").alias("partner")
    )


def best_by_sketch(index: SketchIndex) -> DataFrame:
    """Each unit's best partner with Jaccard as score: ``key, score, partner``; units without one are absent."""
    members = index.members
    # A unit with a copy of its sketch: score 1, the smallest other key. Nothing can beat or precede that.
    copied = members.filter(F.col("copies") > 1)
    smallest = copied.filter(F.col("key") != F.col("rep")).select("key", F.lit(1.0).alias("score"), F.col("rep").alias("partner"))
    first = copied.filter(F.col("key") == F.col("rep")).select("key")
    first = first.join(index.seconds.withColumnRenamed("rep", "key"), "key").select(
        "key", F.lit(1.0).alias("score"), F.col("second").alias("partner")
    )
    alone = members.filter(F.col("copies") == 1).select("key")

    pairs = index.cold_links.withColumnRenamed("jaccard", "score")
    candidates = pairs.select(F.col("a").alias("key"), "score", F.col("b").alias("partner")).unionByName(
        pairs.select(F.col("b").alias("key"), "score", F.col("a").alias("partner"))
    )
    if not index.profiles.isEmpty():
        candidates = candidates.unionByName(_best_hot(index))
    single = best_partner(candidates.join(alone, "key", "left_semi"), "key")
    return smallest.unionByName(first).unionByName(single)


def _best_hot(index: SketchIndex) -> DataFrame:
    """Best hot-only candidates per sketch, found per profile: the members of a profile share them.

    A candidate's score counts hot hashes only. Where the two also share a cold hash that is less than their true
    score, but then ``cold_pairs`` lists the pair with the true one, so the maximum over both is right.
    """
    profiles, members = _fold_profiles(index)
    firsts = profiles.select(F.col("pid"), F.col("sketches"), F.col("second"))
    posts = _profile_posts(profiles)
    numbered = _numbered(profiles.select("pid", "n", "hot"), "pid", "profile-blocks")
    empty = numbered.select("pid", F.lit(0.0).alias("score"), F.col("pid").alias("partner"))
    toward = _by_cell(numbered, _meeting(posts, numbered), _best_of_cell, empty)
    other = best_partner(toward, "pid").select("pid", F.struct("score", "partner").alias("other"))
    own = _within_profiles(profiles).select("pid", F.col("jaccard").alias("own"))
    per_profile = stage(firsts.join(other, "pid", "left").join(own, "pid", "left"), "profile-best")
    rows = lookup_join(members, per_profile, ["pid"], "sketches", "sid")
    sibling = F.when(F.col("sid") == F.col("pid"), F.col("second")).otherwise(F.col("pid"))
    options = F.array(F.col("other"), F.struct(F.col("own").alias("score"), sibling.alias("partner")))
    return (
        rows.select(F.col("sid").alias("key"), F.explode(options).alias("option"))
        .select("key", "option.score", "option.partner")
        .filter(F.col("score").isNotNull())
    )


def attach_matches(matches: DataFrame, units: DataFrame) -> DataFrame:
    """Turn ``key, score, partner`` into the duplication record: partner's name and lines next to the score.

    ``units`` holds ``key, name, qualname, lines``. A popular partner may be named by a third of all units, so the
    lookup of the partner is salted.
    """
    named = stage(matches, "matches")
    popularity = named.groupBy(F.col("partner")).agg(F.count(F.lit(1)).alias("_named_by"))
    partners = units.select(
        F.col("key").alias("partner"),
        name_or_fallback(F.col("qualname"), F.col("name")).alias("other"),
        F.col("lines").alias("lines_other"),
    ).join(popularity, "partner")
    joined = lookup_join(named, stage(partners, "partners"), ["partner"], "_named_by", "key")
    return joined.select("key", "score", F.col("partner").alias("other_id"), "other", "lines_other")

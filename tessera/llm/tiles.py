"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector is rounded to int8 with one scale; the length of what rounding takes off is kept with it. The product of
two rounded vectors then differs from their cosine by no more than a bound from those lengths (Cauchy-Schwarz). Pairs
whose product is clear of the threshold by the bound are decided in the tile; only the others are computed in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.operators.skew import lookup_join
from tessera.session import stage

#: Vectors of a block; a tile is the product of two blocks.
BLOCK = 1024
#: What floating-point arithmetic may add to a bound.
SLACK = 1e-9
COUNT, EDGE, UNSURE = 0, 1, 2


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit vectors as int8, with scale, length of the rounded vector and length of the rounding error."""
    scale = np.maximum(np.abs(unit).max(1, initial=0.0), 1e-300) / 127.0
    rounded = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - rounded * scale[:, None], axis=1)
    return rounded.astype(np.int8), scale, np.linalg.norm(rounded, axis=1) * scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: single precision holds whole numbers up to 2**24, so long rows are cut."""
    step = (1 << 24) // (127 * 127)
    parts = (a[:, i : i + step].astype(np.float32) @ b[:, i : i + step].astype(np.float32).T for i in range(0, max(1, a.shape[1]), step))
    total = np.zeros((len(a), len(b)))
    for part in parts:
        total += part
    return total


def tile(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Boolean matrices: certainly at or above the threshold, and possibly but not certainly."""
    (qa, sa, la, ea), (qb, sb, lb, eb) = a, b
    near = products(qa, qb) * sa[:, None] * sb[None, :]
    bound = la[:, None] * eb[None, :] + ea[:, None] * lb[None, :] + ea[:, None] * eb[None, :] + SLACK
    sure = near - bound >= threshold
    return sure, ~sure & (near + bound >= threshold)


def forest(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the matrix of links joins: each linked row and column with the smallest id it reaches."""
    low_a, low_b = ids_a.copy(), ids_b.copy()
    top = np.iinfo(np.int64).max
    while True:
        next_a = np.minimum(low_a, np.where(links, low_b[None, :], top).min(1, initial=top))
        next_b = np.minimum(low_b, np.where(links, next_a[:, None], top).min(0, initial=top))
        if np.array_equal(next_a, low_a) and np.array_equal(next_b, low_b):
            break
        low_a, low_b = next_a, next_b
    nodes, lows = np.concatenate((ids_a, ids_b)), np.concatenate((low_a, low_b))
    moved = nodes != lows
    return nodes[moved], lows[moved]


def _measured(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id, label, dim, digest, q, scale, length, error, v``; digest is null for a vector that links with nothing.

    ``v`` is the vector as it was given.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, dim, packed, numbers = [], [], [], []
            for known, value in zip(batch.column(1).is_valid().to_pylist(), batch.column(2), strict=True):
                v = None
                if known and value.is_valid and value.values.null_count == 0:
                    v = np.asarray(value.values.to_numpy(zero_copy_only=False), float) + 0.0
                    top = np.abs(v).max(initial=0.0)
                    if not (np.isfinite(v).all() and top > 0):
                        v = None
                if v is None:
                    digest.append(None), dim.append(0), packed.append(None), numbers.append((0.0, 0.0, 0.0))
                    continue
                unit = v / top
                unit = unit / np.linalg.norm(unit)
                q, scale, length, error = quantise(unit[None, :])
                digest.append(hashlib.md5(v.tobytes()).digest()), dim.append(len(v)), packed.append(q.tobytes())
                numbers.append((scale[0], length[0], error[0]))
            floats = np.array(numbers).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(dim, pa.int32()), pa.array(digest, pa.binary()),
                    pa.array(packed, pa.binary()), *(pa.array(floats[:, i]) for i in range(3)), batch.column(2),
                ],
                ["id", "label", "dim", "digest", "q", "scale", "length", "error", "v"],
            )

    given = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(
        measured, f"id long, label string, dim int, digest binary, q binary, scale double, length double, error double, v {given}"
    )


def near_vectors(
    vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK
) -> DataFrame:
    """``<key>, n_links, component_id, kept`` of each row of ``vectors``.

    Vectors of one label, not null, are linked when their cosine in double precision is at least ``threshold``.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest key that links reach. A vector
    that is null, empty, zero, or holds nulls, NaN or infinities links with nothing, and so do vectors of different
    lengths. Equal vectors of a label are folded into one class with a number and a count, so copies cost nothing
    further; rows that repeat a key are vectors of their own for the count and one node for the component. Other columns are not read. A
    null key links with nothing and has a null component.

    Each label is cut into blocks and each pair of blocks is one tile, so no task holds more than two blocks. A tile
    gives back counts, the links of a spanning forest, and the pairs it is not sure of, never all its links.
    """
    found = stage(_measured(vectors, key, vector, label), "vectors")
    good = F.col("digest").isNotNull() & F.col("id").isNotNull()
    classes = stage(
        found.filter(good).groupBy("label", "digest").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("dim", "q", "scale", "length", "error", "v")).alias("of")
        ).select(F.monotonically_increasing_id().alias("cid"), "label", "digest", "rep", "copies", "of.*"),
        "vector-classes",
    )
    blocks = stage(
        classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int")),
        "vector-blocks",
    )
    placed = lookup_join(classes.drop("v"), blocks, ["label", "dim"], "n", "cid").withColumn(
        "own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    )
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "copies",
        "q", "scale", "length", "error",
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        own = group["own"].to_numpy()
        ids, copies = group["cid"].to_numpy(), group["copies"].to_numpy()
        q = np.frombuffer(b"".join(group["q"].to_pylist()), np.int8).reshape(len(ids), -1)
        numbers = [group[c].to_numpy() for c in ("scale", "length", "error")]
        pick = [np.flatnonzero(own == x) for x in (i, j)]
        a, b = ((q[p], *(x[p] for x in numbers)) for p in pick)
        sure, unsure = tile(a, b, threshold)
        if i == j:
            upper = np.triu(np.ones(sure.shape, bool), 1)
            sure, unsure = sure & upper, unsure & upper
        ids_a, ids_b = (ids[p] for p in pick)
        copies_a, copies_b = (copies[p] for p in pick)
        node, low = forest(sure, ids_a, ids_b)
        ua, ub = np.nonzero(unsure)
        n_a, n_b = sure @ copies_b, copies_a @ sure
        some_a, some_b = n_a > 0, n_b > 0
        parts = [
            (COUNT, ids_a[some_a], np.zeros(some_a.sum(), np.int64), n_a[some_a]), (COUNT, ids_b[some_b], np.zeros(some_b.sum(), np.int64), n_b[some_b]),
            (EDGE, node, low, np.zeros(len(node), np.int64)), (UNSURE, ids_a[ua], ids_b[ub], np.zeros(len(ua), np.int64)),
        ]
        return pa.table({
            "label": pa.array([group["label"][0].as_py()] * sum(len(p[1]) for p in parts), pa.string()),
            "kind": pa.array(np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts])),
            **{c: pa.array(np.concatenate([p[x] for p in parts]).astype(np.int64)) for x, c in ((1, "a"), (2, "b"), (3, "n"))},
        })

    told = stage(
        tiles.groupBy("label", "dim", "i", "j").applyInArrow(compare, "label string, kind int, a long, b long, n long"), "tiles"
    )
    # The pairs that the bounds leave open, in full precision.
    unsure = told.filter(F.col("kind") == UNSURE).select("a", "b")

    def with_vector(pairs: DataFrame, side: str) -> DataFrame:
        uses = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_uses"))
        full = classes.select(
            F.col("cid").alias(side), F.col("v").cast("array<double>").alias(f"v{side}"), F.col("copies").alias(f"n{side}")
        ).join(uses, side)
        return lookup_join(pairs, stage(full, "vector-uses"), [side], "_uses", "b" if side == "a" else "a").drop("_uses")

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))
    both = with_vector(with_vector(unsure, "a"), "b")
    linked = stage(both.filter(cosine >= threshold).select("a", "b", "na", "nb"), "vector-links")
    counted = (
        told.filter(F.col("kind") == COUNT).select("a", "n")
        .unionAll(linked.select("a", F.col("nb").alias("n")))
        .unionAll(linked.select(F.col("b").alias("a"), F.col("na").alias("n")))
        .groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    )

    # Classes are also joined by a key that has vectors in both.
    rows = lookup_join(
        found.filter(good).select("id", "label", "digest"), classes.select("cid", "label", "digest", "copies"),
        ["label", "digest"], "copies", "id",
    )
    rows = stage(rows.select("id", "cid", "copies"), "vector-rows")
    several = rows.groupBy("id").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.count(F.lit(1)).alias("n"))
    several = stage(several.filter(F.col("low") < F.col("high")).select("id", "low", "n"), "vector-keys")
    shared = lookup_join(rows.select("id", "cid"), several, ["id"], "n", "cid").select(F.col("cid").alias("a"), F.col("low").alias("b"))
    edges = told.filter(F.col("kind") == EDGE).select("a", "b").unionAll(linked.select("a", "b")).unionAll(shared)
    placed = (
        classes.select("cid", "rep", "copies")
        .join(counted, "cid", "left")
        .join(components(edges).select(F.col("node").alias("cid"), "component"), "cid", "left")
        .select("cid", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component"))
    )
    placed = stage(placed, "vector-placed")
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    named = lookup_join(placed, stage(smallest, "vector-components"), ["component"], "classes", "cid")
    named = stage(
        named.select("cid", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-named"
    )
    whole = lookup_join(rows.select("id", "cid"), named, ["cid"], "copies", "id")
    alone = found.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return whole.select("id", "n_links", "component_id").unionAll(alone).select(
        F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )

"""Joins, pairings and numbering that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stage

# A key is heavy when it owns more than 1/HEAVY_SHARE of all rows, so there are fewer than HEAVY_SHARE of them.
HEAVY_SHARE = 4096
HEAVY_MIN_ROWS = 50_000
BLOCK_ROWS = 2_000


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread_by: str,
) -> DataFrame:
    """Inner equi-join of ``facts`` to ``dim``, which holds each key once and in ``weight`` its number of facts.

    Facts of a heavy key are salted by ``spread_by`` and the key's dim row is repeated per salt, so a key with a
    third of all rows becomes many even join groups. What is broadcast is the list of heavy keys: fewer than
    ``HEAVY_SHARE`` rows by the pigeonhole principle, however large the data. Without a heavy key it is a plain join.
    ``dim`` is read more than once: first for the weights alone, so let it be staged or cheap to compute.
    """
    keys = list(keys)
    stats = dim.agg(F.sum(weight).alias("total"), F.max(weight).alias("top")).first()
    limit = max((stats["total"] or 0) // HEAVY_SHARE, HEAVY_MIN_ROWS)
    if (stats["top"] or 0) <= limit:
        return facts.join(dim, keys)
    salts = F.ceil(F.col(weight) / limit).cast("int")
    heavy = dim.filter(F.col(weight) > limit).select(*keys, salts.alias("_salts"))
    salted_facts = facts.join(F.broadcast(heavy), keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int"), F.lit(0))
    )
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted_facts.join(salted_dim, [*keys, "_salt"]).drop("_salt", "_salts")


def paired_members(
    pairs: DataFrame,
    members: DataFrame,
    group: str,
    member: str,
) -> DataFrame:
    """For group pairs ``(ga, gb, …)`` the member pairs, as structs ``a`` and ``b`` next to the pair's columns.

    ``members`` holds ``group``, ``member`` and payload columns. Groups are cut into blocks of about ``BLOCK_ROWS``
    members and the join key names one block on each side, so no join group is larger than a block squared, whatever
    the group's size. A caller filters the result directly: the pairs stream through the join and are not stored.
    For ``ga = gb`` each pair of different members comes once, smaller member first.
    """
    sizes = stage(members.groupBy(group).agg(F.count(F.lit(1)).alias("_size")), "group-sizes")
    blocks = F.ceil(F.col("_size") / BLOCK_ROWS).cast("int")
    count_a = sizes.select(F.col(group).alias("ga"), blocks.alias("_blocks_a"))
    count_b = sizes.select(F.col(group).alias("gb"), blocks.alias("_blocks_b"))
    grid = (
        pairs.join(count_a, "ga")
        .join(count_b, "gb")
        .withColumn("_block_a", F.explode(F.sequence(F.lit(0), F.col("_blocks_a") - 1)))
        .withColumn("_block_b", F.explode(F.sequence(F.lit(0), F.col("_blocks_b") - 1)))
        .drop("_blocks_a", "_blocks_b")
        .filter((F.col("ga") != F.col("gb")) | (F.col("_block_a") <= F.col("_block_b")))
    )
    blocked = lookup_join(members, sizes, [group], "_size", member).withColumn(
        "_block", F.pmod(F.xxhash64(member), blocks).cast("int")
    )
    payload = F.struct(*[c for c in members.columns])
    cell = ["ga", "_block_a", "gb", "_block_b"]
    left = blocked.select(F.col(group).alias("ga"), F.col("_block").alias("_block_a"), payload.alias("a"))
    right = blocked.select(F.col(group).alias("gb"), F.col("_block").alias("_block_b"), payload.alias("b"))
    lefts = grid.select(*cell).join(left, ["ga", "_block_a"])
    rights = grid.join(right, ["gb", "_block_b"])
    a, b = F.col("a")[member], F.col("b")[member]
    same_block = (F.col("ga") == F.col("gb")) & (F.col("_block_a") == F.col("_block_b"))
    joined = lefts.join(rights, cell).filter(~same_block | (a < b))
    # Inside one group a pair meets in one cell only, in either order: put the smaller member first.
    swap = (F.col("ga") == F.col("gb")) & (a > b)
    carried = [c for c in pairs.columns if c not in ("ga", "gb")]
    return joined.select(
        "ga",
        "gb",
        *carried,
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
    )


def row_numbers(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], output: str, parts: int | None = None
) -> DataFrame:
    """``row_number() OVER (PARTITION BY … ORDER BY …)`` without putting a partition key on one task.

    A window sends each partition key to one task; a folder with a third of all files would end up there. Here the
    rows are range-partitioned by key *and* order, numbered inside each range, and shifted by the row count of the
    ranges before. The table of counts has one row per range and key in it.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in partition_by]
    ranged = stage(
        df.repartitionByRange(parts, *keys, *order_by).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    counts = ranged.groupBy(*partition_by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*partition_by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    within = Window.partitionBy(*partition_by, "_range").orderBy(*order_by)
    return (
        ranged.withColumn("_local", F.row_number().over(within))
        .join(offsets, [*partition_by, "_range"])
        .withColumn(output, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_range", "_local", "_offset")
    )


def following(rows: DataFrame, group: str, key: str, counts: str, output: str) -> DataFrame:
    """Add to each row the smallest larger ``key`` of its group among the rows where ``counts`` holds, or null.

    One sort over ranges of group and key. Inside a range a running window looks back from the largest key; a row whose
    range holds no answer takes the first key of a later range. Only groups that cross a border need that, and a border
    is crossed by one group, so the table of first keys has less than two rows per range and may be broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.col(group), F.col(key), (~F.col(counts)).alias("_last"))
    ranged = stage(ranged.withColumn("_range", F.spark_partition_id()), "following")
    counted = F.when(F.col(counts), F.col(key))
    borders = Window.partitionBy(group)
    heads = (
        ranged.groupBy(group, "_range").agg(F.min(counted).alias("_head"))
        .withColumn("_ranges", F.count(F.lit(1)).over(borders))
        .filter(F.col("_ranges") > 1)
    )
    later = borders.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(group, "_range", F.last("_head", ignorenulls=True).over(later).alias("_beyond"))
    back = Window.partitionBy(group, "_range").orderBy(F.col(key).desc(), F.col(counts).asc())
    inside = F.last(counted, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(heads), [group, "_range"], "left")
        .withColumn(output, F.coalesce("_inside", "_beyond"))
        .drop("_range", "_inside", "_beyond")
    )

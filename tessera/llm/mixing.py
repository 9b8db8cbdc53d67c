"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight, so that taking documents by ascending key is
weighted sampling without replacement. A source first goes into the mix as often as it fits whole; what is left of its
word budget is filled by the documents of smallest key, found by prefix sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD
from tessera.operators.skew import lookup_join, row_numbers
from tessera.session import stage

#: Weights of the sources in order of their names, repeating.
CYCLE = (1.0, 2.0, 3.0)
#: No source is taken more often than this.
MOST_EPOCHS = 3
#: Characters that lower a document's quality weight.
NOISE = "#*$%&|<>!"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def noise_weight(text: Column) -> Column:
    """Quality weight from 0.1 to 1: ten times the share of noise characters is taken off. 1 for an empty text."""
    noise = F.length(text) - F.length(F.translate(text, NOISE, ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 10.0 * noise / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def exponential_key(key: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, with u from the first 52 bits of an MD5 of the key: the same in each run, on each executor."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def running_totals(df: DataFrame, group: str, order_by: Sequence[Column], value: str, output: str) -> DataFrame:
    """Running sum of ``value`` inside ``group`` in the given order, without a group on one task.

    Rows are range-partitioned by group and order, summed inside each range, and shifted by the sums of the ranges
    before, of which there is one row per group and range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, F.col(group), *order_by).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "mix-ranges")
    sums = ranged.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(value).over(within))
    return (
        local.join(offsets, [group, "_range"])
        .withColumn(output, F.col("_local") + F.col("_before"))
        .drop("_range", "_local", "_before")
    )


def source_targets(sources: DataFrame, most: float = MOST_EPOCHS, total: float = 1.0) -> DataFrame:
    """``target`` of each row of the staged ``sources`` (source_size, weight).

    All sources share ``total`` of all sizes by weight; one that would get more than ``most`` times its size gets just
    that, and the excess is shared anew until none is above. Each round is one aggregation over the sources.
    """
    cap = F.col("source_size") * float(most)
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = float(words) * total
    rate, capped_before = 0.0, -1
    while True:
        above = cap < F.col("weight") * rate
        now = sources.agg(
            F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if now["n"] == capped_before or not now["open"]:
            break
        capped_before, rate = now["n"], (budget - (now["taken"] or 0.0)) / now["open"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * rate))


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None,
    weight: Column | None = None, cycle: Sequence[float] = CYCLE, most: float = MOST_EPOCHS, seed: int = 0,
) -> DataFrame:
    """One row per document: ``<key>, source, size, source_size, target, epochs, taken``.

    ``size`` defaults to the number of words, ``weight`` to ``noise_weight``. A null text has size 0; documents of size
    0 and sources without words take nothing. A null source is a source of its own, last in order. Rows that repeat are
    rows of their own, with equal keys, in order of size and text; other columns are not read. The documents of a source are taken
    ``floor(target / source_size)`` times whole, then those of smallest key once more as long as their middle word lies
    within the rest, so a source misses its target by half a document at most.
    """
    text = F.col("text")
    drawn = docs.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        (word_count(text) if size is None else size).cast("long").alias("size"),
        exponential_key(F.col(key), noise_weight(text) if weight is None else weight, seed).alias("rank_key"),
        (F.xxhash64(text) if "text" in docs.columns else F.lit(0)).alias("text_hash"),
    ).withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    drawn = stage(drawn, "mix-drawn")
    sources = stage(
        drawn.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")),
        "mix-sources",
    )
    ordered = row_numbers(sources, [], [F.col("source").asc_nulls_last()], "place")
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.col("place") - 1) % len(cycle) + 1).cast("int"))
    targets = stage(source_targets(stage(ordered.withColumn("weight", weights), "mix-weights"), most), "mix-targets")
    totals = running_totals(drawn, "source_key", [F.col(c) for c in ("rank_key", "key", "size", "text_hash")], "size", "reached")
    joined = lookup_join(
        totals, targets.select("source_key", "source_size", "target", "n_docs"), ["source_key"], "n_docs", "key"
    )
    fits = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    once_more = (F.col("reached") - F.col("size") / 2.0 < rest) & (F.col("size") > 0)
    epochs = F.col("_whole") + F.when(once_more, 1).otherwise(0)
    return joined.withColumn("_whole", fits.cast("long")).select(
        F.col("key").alias(key), "source", "size", "source_size", "target", epochs.cast("long").alias("epochs"),
        (epochs * F.col("size")).cast("long").alias("taken"),
    )

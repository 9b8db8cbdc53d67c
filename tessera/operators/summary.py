"""Summaries of unit metrics: counts, totals, quantiles and shares, over all leaves or per group.

``percentile`` interpolates between order statistics and its state is one counter per distinct value, combined map-side.
The metrics are whole numbers of lines, nodes or comments, and shares rounded to 3 places, so that state stays small
however many units there are. ``continuous_summary`` is for columns that are not: its quantiles sort over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.quantiles import exact_quantiles, same_columns

QUANTILES = (0.5, 0.9)

# The metrics a summary can be asked for.
SELECTABLE = (
    "cyclomatic_complexity", "expressions", "statements", "lines", "type_coverage", "duplication", "todo_comments",
)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _or_zero(x: Column) -> Column:
    """Summaries of no rows at all are 0, not null."""
    return F.coalesce(x, F.lit(0))


def _quantiles(x: Column) -> list[Column]:
    both = F.percentile(x, F.array(*[F.lit(q) for q in QUANTILES]))
    return [_or_zero(both[0]).alias("median"), _or_zero(both[1]).alias("p90")]


def _share(part: Column) -> Column:
    """Share of all rows; null where there are none."""
    return part / F.nullif(F.count(F.lit(1)), F.lit(0))


def _summary(leaves: DataFrame, by: Sequence[str], *columns: Column) -> DataFrame:
    return leaves.groupBy(*by).agg(*columns) if by else leaves.agg(*columns)


def node_counts(nodes: DataFrame) -> DataFrame:
    kind = F.col("nodetype")
    return nodes.agg(
        F.count_if(kind == "file").alias("files"),
        F.count_if(kind == "class").alias("classes"),
        F.count_if(kind.isin("function", "method")).alias("functions"),
    )


def expression_summary(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    x = _zero("expressions")
    return _summary(leaves, by, F.coalesce(F.sum(x), F.lit(0)).alias("total"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"))


def line_summary(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    x = _zero("lines")
    ends = [_or_zero(F.min(x)).alias("min"), _or_zero(F.max(x)).alias("max"), _or_zero(F.avg(x)).alias("mean")]
    return _summary(leaves, by, *ends, *_quantiles(x))


def duplication_summary(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of ``lines`` and ``duplication`` (the score): its distribution, and the lines it weighs."""
    x, n = _zero("duplication"), _zero("lines")
    duplicated = F.sum(n * x)
    return _summary(
        leaves, by, _or_zero(F.avg(x)).alias("mean"), *_quantiles(x), _or_zero(duplicated).alias("duplicated_lines"),
        F.coalesce(duplicated / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0)).alias("share"),
    )


def coverage_summary(leaves: DataFrame, by: Sequence[str] = (), column: str = "type_coverage") -> DataFrame:
    """Missing values are left out; no row comes back where none is left."""
    x = F.col(column)
    present = leaves.filter(x.isNotNull())
    full = F.count_if(x == 1)
    stats = _summary(
        present, by, F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), *_quantiles(x), full.alias("full"),
        _share(full).alias("full_share"),
    )
    return stats.filter(F.col("n") > 0)


def marker_summary(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    x = _zero("todo_comments")
    marked = F.count_if(x > 0)
    return _summary(
        leaves, by, _or_zero(F.sum(x)).alias("total"), marked.alias("marked"), _share(marked).alias("marked_share"),
        _or_zero(F.max(x)).alias("max"),
    )


def unpivot_metrics(leaves: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide to long: one row ``ids…, metric, value`` per unit and metric, missing values kept as null."""
    values = [F.col(m).cast("double").alias(m) for m in metrics]
    return leaves.select(*ids, *values).unpivot(list(ids), list(metrics), "metric", "value")


def select_metric(long: DataFrame, metric: str) -> DataFrame:
    if metric not in SELECTABLE:
        raise ValueError(f"unknown metric {metric!r}")
    return long.filter(F.col("metric") == metric)


def generic_summary(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per metric of a long table; missing values are left out."""
    x = F.col("value")
    return (
        long.filter(x.isNotNull())
        .groupBy(*by, "metric")
        .agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), *_quantiles(x), F.sum(x).alias("total"))
    )


def continuous_summary(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Like ``generic_summary`` for one column whose values are mostly different; missing values are left out."""
    x = F.col(column).cast("double")
    ends = [F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.sum(x).alias("total")]
    stats = _summary(rows.filter(x.isNotNull()), by, F.count(F.lit(1)).alias("n"), *ends).filter(F.col("n") > 0).alias("s")
    found = exact_quantiles(rows, by, column, QUANTILES)
    at = lambda q, name: F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(name)
    ranks = _summary(found, by, at(QUANTILES[0], "median"), at(QUANTILES[1], "p90"), F.max("n").alias("n")).alias("r")
    return stats.join(ranks, same_columns("s", "r", [*by, "n"])).select("s.*", "median", "p90")


def scaled(leaves: DataFrame, column: str) -> DataFrame:
    """Add ``scaled``: the metric's place in its range over all leaves, 0 to 1; 0.5 where all are equal."""
    x = _zero(column)
    low, high = leaves.agg(F.min(x).alias("v")).scalar(), leaves.agg(F.max(x).alias("v")).scalar()
    return leaves.withColumn("scaled", F.coalesce((x - low) / F.nullif(high - low, F.lit(0)), F.lit(0.5)))


def unit_details(long: DataFrame, partners: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Name and value rows of each unit, with the partner's name on the duplication row.

    ``partners`` is ``ids…, other``. Ordering is left to the reader of a unit: ``orderBy(ids, metric)``.
    """
    rows = long.join(partners.withColumn("metric", F.lit("duplication")), [*ids, "metric"], "left")
    return rows.select(*ids, F.replace("metric", F.lit("_"), F.lit(" ")).alias("label"), "value", "other")


def top_units(leaves: DataFrame, column: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` units with the largest metric; each task keeps ``k`` rows, no full sort."""
    return leaves.orderBy(F.col(column).desc(), *ties).limit(k)

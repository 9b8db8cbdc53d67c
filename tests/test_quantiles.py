import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import summary
from tessera.operators.quantiles import exact_quantiles, merge_sketches, quantile_sketches, sketched_quantiles

QS = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)


def found_in(rows, by, value="x", qs=QS):
    return {(*[r[c] for c in by], r["q"]): (r["n"], r["quantile"]) for r in exact_quantiles(rows, by, value, qs).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_numpy(spark, seed):
    """Groups of one row, of one value, with a third of all rows, with ties, and a null group."""
    rng = np.random.default_rng(seed)
    groups = {
        "one": [3.5], "same": [7.0] * 500, "large": list(rng.lognormal(0, 8, 4000)), "ties": [float(v) for v in rng.integers(0, 9, 800)],
        None: list(rng.normal(size=700)), "two": [1.0, 2.0], "signs": [0.0, -0.0, -1e300, 1e300, 5e-324],
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("two", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, x double")
    found = found_in(frame.repartition(5), ["g"])
    assert len(found) == len(groups) * len(QS)
    for g, values in groups.items():
        for q in QS:
            n, value = found[g, q]
            assert n == len(values) and math.isclose(value, np.quantile(values, q), rel_tol=1e-12, abs_tol=1e-300)


def test_two_keys_and_none(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"), F.col("id").alias("x"))
    found = found_in(rows, ["a", "b"], qs=(0.5,))
    assert found == {(a, b, 0.5): (len(v), float(np.median(v))) for a in range(3) for b in range(2) if (v := [i for i in range(1000) if i % 3 == a and i % 2 == b])}
    assert found_in(rows, []) == {(q,): (1000, pytest.approx(999 * q)) for q in QS}
    assert found_in(rows.filter("x < 0"), []) == {} and found_in(rows.filter("x < 0"), ["a"]) == {}


def test_infinite_and_nan_come_last(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, float("inf"), float("nan"), float("-inf"), 2.0)], "x double")
    found = found_in(rows, [], qs=(0.0, 0.25, 0.5, 0.75, 1.0))
    assert [found[q,][1] for q in (0.0, 0.25, 0.5, 0.75)] == [float("-inf"), 1.0, 2.0, float("inf")]
    assert math.isnan(found[1.0,][1])


def test_no_task_holds_the_distinct_values(spark):
    """20,000 different values of one group lie in as many ranges as there are partitions, of about one size."""
    from tessera.operators import quantiles

    staged = {}

    def kept(df, label):
        staged[label] = (real := quantiles_stage(df, label))
        return real

    quantiles_stage = quantiles.stage
    rows = spark.range(20_000).select(F.lit("a").alias("g"), F.sqrt(F.col("id")).alias("x"))
    try:
        quantiles.stage = kept
        assert found_in(rows, ["g"], qs=(0.5,))["a", 0.5][0] == 20_000
    finally:
        quantiles.stage = quantiles_stage
    sizes = [r["count"] for r in staged["quantile-ranges"].groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 20_000 / 3
    assert staged["quantile-places"].count() == 2


def test_continuous_summary_equals_sql(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderpriority", "o_totalprice")
    found = summary.continuous_summary(rows, "o_totalprice", ["o_orderpriority"]).collect()
    expected = duckdb.sql("""
        SELECT o_orderpriority, count(*), quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.9)
        FROM '/root/testdata/sf0.001/orders.parquet' GROUP BY 1""").fetchall()
    assert sorted((r["o_orderpriority"], r["n"], round(r["median"], 6), round(r["p90"], 6)) for r in found) == sorted(
        (g, n, round(m, 6), round(p, 6)) for g, n, m, p in expected
    )
    whole = summary.continuous_summary(rows, "o_totalprice").first()
    assert whole["n"] == rows.count() and whole["min"] <= whole["median"] <= whole["p90"] <= whole["max"]


def test_merged_sketches_stay_near_the_rank(spark):
    rows = spark.range(40_000).select((F.col("id") % 16).alias("day"), (F.col("id") % 2).alias("g"), F.exp(F.rand(3) * 20).alias("x"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    daily = quantile_sketches(rows, ["day", "g"], "x")
    assert max(r["s"] for r in daily.select(F.octet_length("sketch").alias("s")).collect()) < 10_000
    per_group = merge_sketches(daily, ["g"])
    for r in sketched_quantiles(per_group, ["g"], (0.1, 0.5, 0.9)).collect():
        below = rows.filter((F.col("g") == r["g"]) & (F.col("x") <= r["quantile"])).count()
        assert r["n"] == 20_000 and abs(below / 20_000 - r["q"]) < 0.04
    whole = sketched_quantiles(merge_sketches(per_group, []), [], (0.5,)).first()
    assert whole["n"] == 40_000
    assert quantile_sketches(rows.filter("x < 0"), [], "x").isEmpty() and quantile_sketches(rows.filter("x < 0"), ["g"], "x").isEmpty()

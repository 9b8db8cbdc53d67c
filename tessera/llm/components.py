"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import lookup_join
from tessera.session import stage


def _contracted(links: DataFrame) -> DataFrame:
    """One large star and one small star over links ``u > v``; links of the result again have ``u > v``."""
    both = stage(links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "star-both")
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "star-least")
    large = stage(
        lookup_join(both, least, ["u"], "n", "v").filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
        "star-large",
    )
    lower = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "star-lower")
    small = lookup_join(large, lower, ["u"], "n", "v").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stage(small.unionAll(lower.select("u", F.col("m").alias("v"))).distinct(), "star-small")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of the links ``a, b``: the smallest node that it reaches.

    Nodes that are their own smallest are left out. Repeated links, links in both directions and links to itself do no
    harm. Each round contracts stars, so the number of rounds grows with the logarithm of a component's diameter; a
    node with very many links is split over tasks, and each round's table is written to the shared folder.
    """
    links = stage(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "star-links",
    )
    seen = None
    while True:
        now = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not now["n"] or now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, links = now, _contracted(links)

"""The corpus pipeline: quality, line dedup, near-dedup, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_runs, minhash, mixing, pieces, quality
from tessera.llm.common import read
from tessera.llm.queries import LEAST_SCORE, held_out
from tessera.session import stage

#: Near-duplicates here: five-word shingles, similarity 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~held_out(5, 0))
    return quality.keep(docs, model, LEAST_SCORE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents have; ``n_chars`` follows the text. A null text stays null."""
    cleaned = line_runs.drop_lines(docs)
    text = F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n"))
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    return cleaned.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id and text hash.

    Rows are told apart by id and text, so a row that repeats another's id with a text of its own is judged by that
    text; of rows equal in both one stays. A row without an id stays.
    """
    grouped = minhash.near_duplicates(docs, k=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)
    leading = grouped.filter(F.col("leads") & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").alias("lead_id"), F.col("text_hash").alias("lead_hash")
    )
    leading = stage(leading.agg(F.count(F.lit(1)).alias("lead_rows")), "leading")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = (F.col("row.doc_id") == F.col("lead_id")) & (F.xxhash64("row.text") == F.col("lead_hash"))
    single = rows.join(leading.filter("lead_rows = 1"), same).select("row.*")
    repeated = rows.join(leading.filter("lead_rows > 1"), same).dropDuplicates(["lead_id", "lead_hash"]).select("row.*")
    return single.unionAll(repeated).unionAll(docs.filter(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Rows that repeat an id are taken equally often."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("epochs").alias("epochs"))
    wanted = taken.filter(F.col("epochs") > 0)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    often = rows.join(wanted, F.col("row.doc_id").eqNullSafe(F.col("taken_id")))
    return often.select("row", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("epoch")).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document's best segmentation, with the scores of the best few."""
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the classifier nor the segmentation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

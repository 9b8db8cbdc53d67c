"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import archive, contain, dialogue, divergence, language, line_runs, minhash, mixing, pieces, quality, ranked, tiles, toxicity
from tessera.llm.common import fold_of, read

#: A score from here on predicts label 1.
LEAST_SCORE = 0.3


def held_out(parts: int, rest: int) -> Column:
    """Rows kept from learning; a null key is never learned from."""
    return F.coalesce(fold_of("doc_id", parts) == rest, F.lit(True))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = language.fit_trees(docs, ~held_out(5, 0))
    return language.identify(docs, trees).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


def _predicted(scored: DataFrame, parts: int, rest: int) -> DataFrame:
    predicted = (F.col("score") >= LEAST_SCORE).cast("int")
    return scored.select("doc_id", held_out(parts, rest).alias("held_out"), "score", predicted.alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~held_out(5, 0))
    return _predicted(quality.score(docs, model), 5, 0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.drop_lines(docs).select(
        "row.doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = minhash.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)
    return grouped.select("doc_id", "n_shingles", "component_id", "kept")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.judge(read(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out(4, 2))
    return _predicted(toxicity.score(docs, model), 4, 2)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), pieces.load())


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = archive.restore(archive.write_archive(read(spark, sf_dir, "pages")))
    return read_back.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contain.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    repaired = dialogue.repair(dialogue.damage(rows)).digests()
    every = rows.select(F.col("conv_id").alias("every_id")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(repaired, F.col("every_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_quality, op3_line_dedup, op4_minhash_dedup, op5_embedding_dedup, op6_quality_rules,
    op7_toxicity, op8_sentencepiece, op9_mix_sources, op10_warc_archive, op11_benchmark_decontamination,
    op12_conversation_repair, op13_ranked_search,
)}

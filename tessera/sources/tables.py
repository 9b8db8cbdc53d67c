"""Text tables as units: documents, pages and conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import line_count, text_tokens, url_path
from tessera.session import spread



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_path() -> Column:
    return F.concat(F.lit("/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))


def document_units(documents: DataFrame) -> DataFrame:
    """``key, path, name, lines, n_chars`` of each document; the text itself is only counted."""
    return documents.select(
        F.col("doc_id").alias("key"),
        document_path().alias("path"),
        F.col("doc_id").cast("string").alias("name"),
        F.lit("").alias("qualname"),
        line_count(F.col("text")).alias("lines"),
        "n_chars",
    )


def page_paths(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", url_path(F.col("url")).alias("path"))


def token_units(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tokens`` for sketching, spread over the cores before the per-token work."""
    return spread(rows.select(key, text)).select(F.col(key).alias("key"), text_tokens(F.col(text)).alias("tokens"))


def text_units(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text`` for sketching: as ``token_units``, with the tokens left to the sketch."""
    return spread(rows.select(key, text)).select(F.col(key).alias("key"), F.col(text).alias("text"))

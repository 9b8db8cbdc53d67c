"""Compression classifier of text quality.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled bad. A text is compressed
piece by piece with each; the difference of the compressed sizes over their sum says which dictionary knows it better.
A logistic curve, fitted on labelled documents that the dictionaries have not seen, turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import over_cores, share_filter, slices, text_buffers
from tessera.session import stage

PIECE = 4096
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: About so many labelled documents of each class are learned from, half for the dictionaries, half for the curve;
#: documents of more bytes than FIT_LONGEST are not used for learning.
FIT_DOCS = 3000
FIT_LONGEST = 20_000


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made


def sizes(text: memoryview, compressors: list[zstandard.ZstdCompressor]) -> tuple[int, ...]:
    """Compressed size of the whole text under each dictionary."""
    pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    return tuple(sum(len(c.compress(p)) for p in pieces) for c in compressors)


def features(found: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Columns: one, the normalised difference (above 0: the good dictionary is the better one), it by log size, and
    how far the text compresses at all, as endless repetition does under either dictionary."""
    both = np.maximum(found.sum(1), 1)
    difference = (found[:, 1] - found[:, 0]) / both
    shrunk = np.minimum(0.0, np.log(both / np.maximum(2 * lengths, 1)) + 1.2)
    return np.stack([np.ones(len(found)), 10 * difference, difference * np.log1p(lengths), shrunk], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(good: list[bytes], bad: list[bytes], share_good: float) -> CompressionModel:
    """Dictionaries from the even documents of each class, the curve from the odd ones at the true class shares."""

    def dictionary(texts: list[bytes]) -> bytes:
        pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
        pieces = [p for p in pieces if len(p) >= 8]
        if sum(map(len, pieces)) < 32 << 10 or len(pieces) < 8:  # too little to train on: the text itself
            return b"".join(pieces)[-DICTIONARY_BYTES:] or b"\n" * 8
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()

    model = CompressionModel(dictionary(good[::2]), dictionary(bad[::2]), (0.0, 0.0, 0.0, 0.0))
    rest = [(t, 1.0) for t in good[1::2]] + [(t, 0.0) for t in bad[1::2]]
    y = np.array([label for _, label in rest])
    if not len(y) or y.min() == y.max():
        even = np.clip(share_good, 0.01, 0.99)
        return CompressionModel(model.good, model.bad, (float(np.log(even / (1 - even))), 0.0, 0.0, 0.0))
    both = model.compressors()
    x = features(np.array([sizes(memoryview(t), both) for t, _ in rest], float), np.array([len(t) for t, _ in rest], float))
    weight = np.where(y == 1, share_good / y.mean(), (1 - share_good) / (1 - y.mean()))
    return CompressionModel(model.good, model.bad, tuple(map(float, logistic(x, y, weight))))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, fit_docs: int, key: str = "doc_id", text: str = "text",
    longest: int = FIT_LONGEST,
) -> tuple[list[tuple[bytes, int]], float]:
    """A bounded sample of labelled texts in order of a hash of the key, and the share of label 1.

    A hash of the key picks about ``fit_docs`` labelled rows of each class, so the picked keys are few and may be
    broadcast. Null labels and texts teach nothing; a key with several labels counts by the largest.
    """
    known = labels.filter(F.col(label).isNotNull() & learn).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(count.values())
    if not total:
        return [], 0.5
    share = F.lit(0.0)
    for y, n in count.items():
        share = F.when(F.col("y") == y, min(1.0, fit_docs / n)).otherwise(share)
    picked = stage(known.filter(share_filter("k", share)), "fit-labels")
    rows = (
        docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
        .join(F.broadcast(picked), "k")  # about fit_docs rows a class
        .filter(F.octet_length("text").between(1, longest))
        .dropDuplicates(["k"])
        .orderBy(F.xxhash64(F.lit(7), "k"), "k")
        .select("text", "y")
        .collect()
    )
    return [(r["text"].encode(), int(r["y"])) for r in rows], count.get(1, 0) / total


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", fit_docs: int = FIT_DOCS) -> CompressionModel:
    sample, share = labelled_sample(docs, labels, label, learn, fit_docs)
    return train([t for t, y in sample if y == 1], [t for t, y in sample if y != 1], share)


def scores(rows: DataFrame, model: CompressionModel, text: str = "text", keep_from: float | None = None) -> DataFrame:
    """``key, score`` of rows ``key, text``, or with ``keep_from`` the rows themselves that score at least that.

    An empty or null text has no difference and gets the curve's value there. Each piece of a text is compressed by
    itself, so memory does not grow with the text.
    """

    def of(column: pa.Array, both: list, weights: np.ndarray) -> np.ndarray:
        offsets, data = text_buffers(column)
        view = memoryview(data)
        found = np.array([sizes(view[a:b], both) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], float).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(features(found, np.diff(offsets).astype(float)) @ weights, -30, 30)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, weights = model.compressors(), np.array(model.weights)
        for batch in slices(batches, text):
            score = of(batch.column(batch.schema.get_field_index(text)), both, weights)
            if keep_from is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["key", "score"])
            else:
                yield batch.filter(pa.array(score >= keep_from))

    if keep_from is not None:
        return rows.mapInArrow(scored, rows.schema)
    return rows.mapInArrow(scored, f"key {rows.schema['key'].dataType.simpleString()}, score double")


def score(docs: DataFrame, model: CompressionModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, score`` of each row of ``docs``; other columns are not read, rows that repeat each get their row."""
    rows = over_cores(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    return scores(rows, model).select(F.col("key").alias(key), "score")


def keep(docs: DataFrame, model: CompressionModel, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``least``."""
    return scores(docs, model, text, keep_from=least)

"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree: contexts of up to three bytes with their symbol counts. A symbol
seen in a context costs -log2(c / (n + d)), with n symbols and d distinct ones seen there; another one costs the escape
-log2(d / (n + d)) and then its code length in the next shorter context, renormalised over what the longer one lacks.
The statistics are frozen after training, so each context's code lengths are a fixed row of a table, each row's
probabilities sum to one, and scoring a text is a gather and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import over_cores, share_filter, slices, text_buffers
from tessera.session import stage

#: Bytes before the predicted one.
ORDER = 3
#: A text starts as if after a line break.
START = 10
#: About so many bytes of each language are learned; a hash of the key decides which documents.
FIT_BYTES = 1_500_000
#: Contexts of three bytes seen less often than this in every language are left to their shorter ones.
MIN_CONTEXT = 2
UNKNOWN = "und"


@dataclass(frozen=True)
class ContextTrees:
    """Frozen statistics: byte classes, the row of each context, and ``cost[row, class, language]`` in bits."""

    languages: list[str]
    classes: np.ndarray
    rows: np.ndarray
    cost: np.ndarray

    def bits(self, offsets: np.ndarray, data: np.ndarray, window: int = 1 << 19) -> np.ndarray:
        """Code length of each text under each language; texts are bytes ``offsets[i]:offsets[i + 1]`` of ``data``."""
        symbols, total = self.classes[data].astype(np.int32), np.zeros((len(offsets) - 1, len(self.languages)))
        size, starts = self.rows.shape[0], offsets[:-1]
        flat, start = self.cost.reshape(-1, len(self.languages)), int(self.classes[START])
        n_classes = self.cost.shape[1]
        for low in range(0, len(data), window):
            high = min(low + window, len(data))
            padded = np.concatenate((np.full(max(0, ORDER - low), start, np.int32), symbols[max(0, low - ORDER) : high]))
            near = padded[ORDER:]
            back = [padded[ORDER - k : len(padded) - k].copy() for k in range(1, ORDER + 1)]
            first, last = np.searchsorted(offsets, low, side="right") - 1, np.searchsorted(starts, high, side="left")
            own = starts[max(0, first) : last]
            for k in range(1, ORDER + 1):  # what would lie before a text's first byte
                for ahead in range(k):
                    at = own + ahead - low
                    back[k - 1][at[(at >= 0) & (at < high - low) & (own + ahead < offsets[max(0, first) + 1 : last + 1])]] = start
            row = self.rows.reshape(-1)[(back[2] * size + back[1]) * size + back[0]]
            sums = np.zeros((high - low + 1, len(self.languages)))
            np.cumsum(flat[row * n_classes + near], axis=0, dtype=np.float64, out=sums[1:])
            touched = np.arange(max(0, first), last)
            ends = np.clip(offsets[touched + 1] - low, 0, high - low)
            total[touched] += sums[ends] - sums[np.clip(offsets[touched] - low, 0, high - low)]
        return total


def build_trees(grams: dict[str, tuple[np.ndarray, np.ndarray]], min_context: int = MIN_CONTEXT) -> ContextTrees:
    """Trees from each language's counts of runs of four bytes (big-endian in 32 bits)."""
    languages = sorted(grams)
    seen = np.zeros(256, bool)
    seen[START] = True
    for runs, _ in grams.values():
        for shift in (0, 8, 16, 24):
            seen[np.unique((runs >> shift) & 255)] = True
    # Bytes that no language has seen cost the same in every context, so they share one class.
    unseen = int((~seen).sum())
    size = int(seen.sum()) + (unseen > 0)
    classes = np.full(256, size - 1, np.uint8)
    classes[seen] = np.arange(int(seen.sum()))
    width = np.ones(size)
    if unseen:
        width[-1] = unseen
    split = {
        lang: ([classes[(runs >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0)], counts.astype(np.float64))
        for lang, (runs, counts) in grams.items()
    }
    contexts = np.zeros(size**3)
    for (a, b, c, _), n in split.values():
        contexts = np.maximum(contexts, np.bincount((a * size + b) * size + c, n, size**3))
    long = np.flatnonzero(contexts >= min_context)
    long_row = np.full(size**3, -1, np.int64)
    long_row[long] = np.arange(len(long)) + size * size
    pairs = np.arange(size**3) % (size * size)
    rows = np.where(long_row >= 0, long_row, pairs).astype(np.int32)
    cost = np.empty((size * size + len(long), size, len(languages)), np.float32)
    uniform = width / 256.0
    for at, lang in enumerate(languages):
        (a, b, c, s), n = split[lang]
        zero = _blend(np.bincount(s, n, size)[None, :], uniform[None, :])
        one = _blend(np.bincount(c * size + s, n, size * size).reshape(size, size), np.repeat(zero, size, 0))
        two = _blend(np.bincount((b * size + c) * size + s, n, size**3).reshape(-1, size), np.tile(one, (size, 1)))
        cost[: size * size, :, at] = -np.log2(two / width)
        place = long_row[(a * size + b) * size + c] - size * size
        ok = place >= 0
        for low in range(0, len(long), 4096):
            part = ok & (place >= low) & (place < low + 4096)
            high = min(low + 4096, len(long))
            counts = np.bincount((place[part] - low) * size + s[part], n[part], (high - low) * size).reshape(-1, size)
            three = _blend(counts, two[long[low:high] % (size * size)])
            cost[size * size + low : size * size + high, :, at] = -np.log2(three / width)
    return ContextTrees(languages, classes, rows.reshape(size, size, size), cost)


def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of each class in contexts with these counts, given those in the next shorter contexts."""
    n, seen = counts.sum(1, keepdims=True), counts > 0
    d = seen.sum(1, keepdims=True)
    left = np.where(seen, 0.0, shorter).sum(1, keepdims=True)
    known = left <= 1e-12  # nothing to escape to
    total = np.where(known, n, n + d)
    with np.errstate(divide="ignore", invalid="ignore"):
        mixed = np.where(seen, counts / total, d / total * shorter / left)
    return np.where(n > 0, mixed, shorter)


def count_runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of four bytes, with three start bytes before each text, and their counts."""
    found, ahead = [], np.full(ORDER, START, np.uint8)
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        x = np.concatenate((ahead, data[low:high])).astype(np.uint32)
        found.append(x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:])
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)


def fit_trees(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_bytes: int = FIT_BYTES
) -> ContextTrees:
    """Learn from the rows of ``docs`` where ``learn`` holds and ``lang`` and ``text`` are not null.

    The sample is bounded: a hash of the key picks each language's documents so that they have about ``fit_bytes``.
    So that no language with a text goes missing, its text of smallest hash is always learned, up to ``fit_bytes``
    characters where the sample left it out. The driver gets the summed counts of runs of four bytes, which that sample bounds. Without rows to learn from
    there is no language, and every text is ``und``.
    """
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    draw = F.xxhash64(key, text)
    sizes = (
        known.filter(F.col(text) != "").groupBy(F.col(lang).alias("lang"))
        .agg(F.sum(F.octet_length(text)).alias("bytes"), F.min(draw).alias("first")).collect()
    )
    if not sizes:
        return build_trees({})

    def of_language(value) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], value(r))]), F.col(lang))

    share = of_language(lambda r: min(1.0, fit_bytes / r["bytes"]))
    drawn = F.coalesce(share_filter(key, share), F.lit(False))
    learned = F.when(drawn, F.col(text)).when(draw == of_language(lambda r: r["first"]), F.left(F.col(text), F.lit(fit_bytes)))
    sample = known.select(F.col(lang).alias("lang"), learned.alias("text")).filter(F.col("text").isNotNull())

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, rows = batch.column(0).dictionary_encode(), batch.column(1)
            for at, name in enumerate(langs.dictionary.to_pylist()):
                own = rows.filter(pa.compute.equal(langs.indices, at))
                runs, n = count_runs(*text_buffers(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(runs), pa.string()), pa.array(runs.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "run", "n"],
                )

    summed = stage(
        sample.mapInArrow(counts, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")), "ppm-runs"
    )
    got = summed.toPandas()
    return build_trees({
        str(name): (own["run"].to_numpy(np.uint32), own["n"].to_numpy(np.int64)) for name, own in got.groupby("lang")
    })


def identify(docs: DataFrame, trees: ContextTrees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, lang_pred, score`` of each row of ``docs``.

    The language of the shortest code wins, a tie goes to the first by name; ``score`` is its posterior under equal
    priors. A text that is null or has no letter is ``und`` with score 0, as is every text without trees. Rows that
    repeat each get their row; other columns are not read. Long texts are scored in windows, so a task holds one text
    and a window's code lengths. The table of trees goes to the executors once, as a broadcast bounded by the sample.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees)
    rows = over_cores(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").select(
        "key", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), "text"
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in slices(batches, "text"):
            lettered = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool) & bool(model.languages)
            best, score = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows)
            if model.languages:
                bits = model.bits(*text_buffers(batch.column(2)))
                least = bits.min(1, keepdims=True)
                odds = np.exp2(np.maximum(least - bits, -1000.0))
                best = np.where(lettered, bits.argmin(1), best)
                score = np.where(lettered, 1.0 / odds.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["key", "lang_pred", "score"]
            )

    kind = docs.schema[key].dataType.simpleString()
    out = rows.mapInArrow(scored, f"key {kind}, lang_pred string, score double")
    return out.select(F.col("key").alias(key), "lang_pred", "score")

"""Ranked lexical search: an Aho-Corasick automaton of all item terms reads the documents' texts.

There is no index of the documents. The distinct terms of the items, each between two guard blanks, form one automaton
that is broadcast; a task runs it over its texts, in which every separator is such a blank, so that a match is a whole
term and its place names the document. Two scans are made: the first sums in how many documents each item term stands,
the second scores, and hands on only each item's best of a task. What is shuffled does not grow with the texts.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, over_cores, slices, text_buffers

#: Documents listed for each item.
TOP = 20
#: Bytes of item texts in one automaton; more items make more automata, each with scans of its own.
BLOCK_BYTES = 16 << 20
#: Bytes of text, scores and products held at a time.
PIECE_BYTES = 4 << 20
CELLS = 2 << 20

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
GUARD = 0x20


def _byte_classes() -> np.ndarray:
    """What each byte of a text becomes: separators the guard, A-Z lower-case, all other bytes themselves."""
    out = np.arange(256, dtype=np.uint8)
    out[:128][[not chr(b).isalnum() for b in range(128)]] = GUARD
    out[ord("A") : ord("Z") + 1] += 32
    return out


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_ASCII_LOWER))


@dataclass
class Items:
    """A block of items: their ids, the distinct terms, and for each term the items that hold it and how often."""

    ids: list
    terms: list[str]
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[tuple]) -> Items:
        held = [Counter(terms_of(text)) for _, text in rows]
        terms = sorted(set().union(*held)) if held else []
        number = {t: i for i, t in enumerate(terms)}
        triples = sorted((number[t], k, n) for k, own in enumerate(held) for t, n in own.items())
        term, item, times = np.array(triples, np.int64).reshape(-1, 3).T
        start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms)))))
        return cls([i for i, _ in rows], terms, start.astype(np.int64), item, times)

    @cached_property
    def automaton(self):
        """Built once in each Python worker. Bytes stand as characters of the same number."""
        import ahocorasick

        built = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            built.add_word(f" {term.encode().decode('latin-1')} ", i)
        if self.terms:
            built.make_automaton()
        return built

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, and ``document, term, tf`` of the item terms in them, sorted by document."""
        offsets, data = text_buffers(column)
        texts = np.insert(_CLASSES[data], offsets, GUARD)
        starts = offsets[:-1] + np.arange(len(column))
        opened = np.concatenate(([0], np.cumsum((texts[:-1] == GUARD) & (texts[1:] != GUARD))))
        size = opened[offsets[1:] + np.arange(1, len(column) + 1)] - opened[starts]
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = 0
        while self.terms and low < len(texts) - 1:
            # A piece ends at a guard, which the next one begins with; a longer term makes a longer piece.
            high = min(low + PIECE_BYTES, len(texts) - 1)
            while texts[high] != GUARD:
                step = texts[high : high + PIECE_BYTES] == GUARD
                high += int(step.argmax()) if step.any() else len(step)
            piece = texts[low : high + 1].tobytes().decode("latin-1")
            found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(piece)), np.int64).reshape(-1, 2)
            document = np.searchsorted(starts, found[:, 0] + low - 1, side="right") - 1
            key, n = np.unique(document * len(self.terms) + found[:, 1], return_counts=True)
            keys.append(key)
            times.append(n)
            low = high
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        tf = np.zeros(len(key), np.int64)
        np.add.at(tf, place, np.concatenate(times))
        return size, key // max(1, len(self.terms)), key % max(1, len(self.terms)), tf


_CLASSES = _byte_classes()


class Best:
    """The ``top`` best documents of each item: higher score first, then smaller id, null ids last."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.pool, self.pending = [np.zeros((4, 0), np.int64)], 0  # item, score, whether the id is null, id

    def add(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        self.pool.append(np.stack([item, score, null, doc]))
        self.pending += len(item)
        if self.pending > max(50_000, 2 * self.top * len(self.least)):
            self.rows()

    def rows(self) -> np.ndarray:
        rows = np.concatenate(self.pool, axis=1)
        item, score, null, doc = rows
        rows = rows[:, np.lexsort((doc, null, -score, item))]
        rank = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        rows, rank = rows[:, rank < self.top], rank[rank < self.top]
        full = rank == self.top - 1
        self.least[rows[0, full]] = rows[1, full]  # an equal score may still win by its id
        self.pool, self.pending = [rows], 0
        return rows


def _frequencies(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """In how many texts each item term stands; under -1 the texts with a term, under -2 their terms."""
    df, texts, total = np.zeros(len(items.terms), np.int64), 0, 0
    for batch in slices(batches, "text", PIECE_BYTES):
        size, _, term, _ = items.counts(batch.column("text"))
        df += np.bincount(term, minlength=len(df))
        texts, total = texts + int((size > 0).sum()), total + int(size.sum())
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({
        "term": pa.array([*seen.tolist(), -1, -2], pa.int64()), "n": pa.array([*df[seen].tolist(), texts, total], pa.int64()),
    })


def _scored(batches, items: Items, weight: np.ndarray, texts: int, total: int, top: int, first: int) -> Iterator[pa.RecordBatch]:
    """Each item's best documents among a task's, as ``item, doc, score``."""
    best, n_items = Best(len(items.ids), top), len(items.ids)
    held = np.diff(items.start)
    for batch in slices(batches, "text", PIECE_BYTES):
        size, document, term, tf = items.counts(batch.column("text"))
        mixed = np.array([75 + 25 * n * texts // total for n in size.tolist()] if total else [], np.int64)
        gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * mixed[document])) if total else tf
        null = np.asarray(batch.column("key").is_null(), np.int64)
        ids = batch.column("key").fill_null(0).to_numpy(zero_copy_only=False)
        rows = max(1, CELLS // max(1, n_items))
        for low in range(0, batch.num_rows, rows):
            span = slice(*np.searchsorted(document, (low, low + rows)))
            sums = np.zeros((min(rows, batch.num_rows - low), n_items), np.int64)
            # Each match counts for every item that holds the term; the products are made some at a time.
            ends = np.cumsum(held[term[span]])
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
                t, part = term[span][at:to], held[term[span][at:to]]
                place = np.repeat(items.start[t] + part - np.cumsum(part), part) + np.arange(part.sum())
                own = np.repeat(document[span][at:to] - low, part)
                np.add.at(sums, (own, items.item[place]), np.repeat(gain[span][at:to], part) * items.times[place])
                at = to
            row, item = np.nonzero(sums >= best.least)
            best.add(item, sums[row, item], null[low + row], ids[low + row])
    item, score, null, doc = best.rows()
    yield pa.RecordBatch.from_pydict({
        "item": pa.array(item + first), "doc": pa.array(doc, mask=null.astype(bool)), "score": pa.array(score),
    })


def _of_block(docs: DataFrame, items: Items, top: int, first: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    counted = docs.mapInArrow(lambda b: _frequencies(b, shared.value), "term long, n long")
    sums = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    texts, total = sums.get(-1, 0), sums.get(-2, 0)
    weight = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * sums.get(i, 0) + 1))) for i in range(len(items.terms))], np.int64)
    return docs.mapInArrow(
        lambda b: _scored(b, shared.value, weight, texts, total, top, first), "item long, doc long, score long"
    )


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``<item_key>, rank, <key>, score``: the ``top`` documents of each item with a score above 0, best first.

    A null or empty text, of a document or an item, has no terms: such a document does not count, such an item has no
    rows. Equal scores go by ascending ``key``, nulls last. Rows that repeat are documents, or items, of their own; a
    repeated item's lists come under the same id. Empty tables give no rows. Other columns are not read.

    Items are dealt by hash over blocks of about ``block_bytes``, so that an automaton, the one thing that is broadcast
    and that the driver holds, has a bound whatever the number of items; only a single longer item makes it larger.
    A task hands on ``top`` rows an item; these are cut once more in groups before the last cut of an item.
    """
    spark = docs.sparkSession
    rows = over_cores(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "key")
    wanted = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("text")).filter(F.length("text") > 0)
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = size // block_bytes + 1
    found, names, kind = [], [], items.schema[item_key].dataType.simpleString()
    for block in range(blocks):
        own = wanted.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        own = sorted(map(tuple, own), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        first = block << 32
        found.append(_of_block(rows, Items.of(own), top, first))
        names.append(spark.createDataFrame([(first + i, r[0]) for i, r in enumerate(own)], f"item long, item_id {kind}"))
    scored, named = reduce(DataFrame.unionAll, found), reduce(DataFrame.unionAll, names)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    groups = max(1, math.isqrt(docs.rdd.getNumPartitions()))
    dealt = scored.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(groups)))
    first_cut = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
    last_cut = first_cut.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return last_cut.join(named, "item").select(
        F.col("item_id").alias(item_key), "rank", F.col("doc").alias(key), "score"
    )

"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

Forward Viterbi gives the best score of each prefix. A search from the end of the text back to its start then extends
partial suffixes, and the forward score of what is left is an exact heuristic: the first N complete paths that leave the
queue are the N best. No piece goes over the start of a word, so the lattice of a text falls apart there: words are
searched by themselves, the common ones once for many texts, and a text's N best are put together from the words in
which a change costs least.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import over_cores, slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 3
SPACE = "▁"
#: A word is its marks of white space and what follows up to the next one; a line break is a word of its own.
_WORD = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Longest word of the vectorised search, rows of it at a time, and words remembered by a task.
WIDTH = 32
BLOCK = 8192
REMEMBERED = 300_000
#: What a character without a piece costs beyond the rarest piece.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their scores, and the ids of the 256 byte pieces (empty without byte fallback)."""

    pieces: dict[str, int]
    scores: np.ndarray
    surface: list[bytes]
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Read a model file. Scores that are merge ranks become log-probabilities by Zipf's law, -ln(rank + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    names = [model.id_to_piece(i) for i in ids]
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return vocabulary(
        [(names[i], i, model.get_score(i)) for i in plain],
        names,
        [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(model.is_byte, ids)) else [],
        model.unk_id(),
    )


def vocabulary(plain: Sequence[tuple[str, int, float]], names: Sequence[str], byte_ids: list[int], unknown: int) -> Vocabulary:
    scores = np.full(len(names), -np.inf)
    ranked = all(float(s).is_integer() for _, _, s in plain)
    for rank, (_, i, score) in enumerate(plain):
        scores[i] = -np.log(rank + 1.0) if ranked else score
    surface = [n.replace(SPACE, " ").encode() for n in names]
    for b, i in enumerate(byte_ids):
        surface[i] = bytes([b])
    worst = float(scores[np.isfinite(scores)].min()) if plain else 0.0
    return Vocabulary({p: i for p, i, _ in plain}, scores, surface, byte_ids, unknown, worst - UNKNOWN_PENALTY)


def split_words(text: str) -> list[str]:
    """White space marked, cut where no piece can go across; joined they are the marked text."""
    return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def nbest(vocab: Vocabulary, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations of a marked text (fewer if there are fewer): score and piece ids, best first.

    The forward scores are exact, so a place leaves the queue with its best suffix first; no more than ``n`` suffixes of
    a place can be among the ``n`` best of the whole, and later ones are not extended. Of equal scores the one whose
    last pieces are shorter goes first, as far as sums of scores are equal to the last bit.
    """
    end, longest, pieces, scores = len(text), vocab.longest, vocab.pieces, vocab.scores
    forward = [0.0] + [-np.inf] * end
    into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(end + 1)]
    for j in range(1, end + 1):
        for i in range(max(0, j - longest), j):
            at = pieces.get(text[i:j])
            if at is not None:
                edge = (i, float(scores[at]), (at,))
            elif i == j - 1:
                byte = vocab.byte_ids
                edge = (i, vocab.unknown_score, tuple(byte[b] for b in text[i].replace(SPACE, " ").encode()) if byte else (vocab.unknown_id,))
            else:
                continue
            into[j].append(edge)
            forward[j] = max(forward[j], forward[i] + edge[1])
    found, order, left = [], 0, [n] * (end + 1)
    queue: list = [(-forward[end], 0, end, 0.0, None)]
    while queue and len(found) < n:
        cost, _, j, behind, path = heapq.heappop(queue)
        if j == 0:
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((-cost, tuple(ids)))
            continue
        if not left[j]:
            continue
        left[j] -= 1
        for i, score, ids_of in into[j]:
            order -= 1
            heapq.heappush(queue, (-(forward[i] + score + behind), order, i, behind + score, (ids_of, path)))
    return found


class Segmenter:
    """Best segmentation of many words at once, with what the second best of each loses."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.longest = vocab, vocab.longest
        self.bits = max(12, int(np.ceil(np.log2(max(1, len(vocab.pieces)) * 16))))
        self.mask = np.uint64((1 << self.bits) - 1)
        keys = self._hashes_of(list(vocab.pieces))
        self.slot_key = np.zeros(1 << self.bits, np.uint64)
        self.slot_id = np.full(1 << self.bits, -1, np.int32)
        for key, at in zip(keys.tolist(), vocab.pieces.values(), strict=True):
            slot = self._slot(np.array([key], np.uint64))[0]
            while self.slot_id[slot] >= 0:
                slot = (slot + np.uint64(1)) & self.mask
            self.slot_key[slot], self.slot_id[slot] = key, at
        self.score = np.append(vocab.scores, -np.inf)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.fresh: list[str] = []
        self.best, self.gap, self.count = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.several: dict[str, list] = {}

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def _slot(self, key):
        return (key ^ (key >> np.uint64(29))) * self.MULTIPLIER >> np.uint64(64 - self.bits)

    def _hashes_of(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for k, word in enumerate(words):
            h = 0
            for c in word:
                h = (h * 0xD6E8FEB86659FD93 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            out[k] = h
        return out

    def _lookup(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        found = self.slot_id[slot]
        wrong = np.flatnonzero((found >= 0) & (self.slot_key[slot] != key))
        while len(wrong):
            slot[wrong] = (slot[wrong] + np.uint64(1)) & self.mask
            found[wrong] = self.slot_id[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.slot_key[slot[wrong]] != key[wrong])]
        return found

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, giving new ones to words not met before."""
        index, fresh = self.index, self.fresh
        for w in set(words):
            if w not in index:
                index[w] = len(index)
                fresh.append(w)
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        """Segment the words that have a number but no segmentation yet."""
        words, self.fresh = self.fresh, []
        if not words:
            return
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        best, gap, ids = np.zeros(len(words)), np.zeros(len(words)), [None] * len(words)
        order, rest = np.argsort(lengths, kind="stable"), list(np.flatnonzero(lengths > WIDTH))
        order = order[lengths[order] <= WIDTH]
        for low in range(0, len(order), BLOCK):
            rest += self._block([words[k] for k in order[low : low + BLOCK]], order[low : low + BLOCK], lengths, best, gap, ids)
        for k in rest:
            two = nbest(self.vocab, words[k], 2)
            best[k], gap[k] = two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf
            ids[k] = np.array(two[0][1], np.int32)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(count) - count)
        self.flat = np.concatenate([self.flat, *ids]) if len(ids) else self.flat
        self.best, self.gap = np.append(self.best, best), np.append(self.gap, gap)
        self.count = np.append(self.count, count)

    def _block(self, words, where, lengths, best, gap, ids) -> list[int]:
        """Forward and backward Viterbi over words of similar length; gives back those with unknown characters."""
        n, width = len(words), int(lengths[where].max())
        own = lengths[where]
        codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(n, width).T.astype(np.uint64) + np.uint64(1)
        piece: dict[tuple[int, int], np.ndarray] = {}
        unknown = np.zeros(n, bool)
        for i in range(width):
            h = np.zeros(n, np.uint64)
            for size in range(1, min(self.longest, width - i) + 1):
                h = h * np.uint64(0xD6E8FEB86659FD93) + codes[i + size - 1]
                found = self._lookup(h)
                if size == 1:
                    unknown |= (found < 0) & (own > i)
                piece[i, size] = np.where(own >= i + size, found, -1)
        forward = np.full((width + 1, n), -np.inf)
        back = np.zeros((width + 1, n), np.int64)
        forward[0] = 0
        for j in range(1, width + 1):
            for size in range(1, min(self.longest, j) + 1):
                value = forward[j - size] + self.score[piece[j - size, size]]
                better = value > forward[j]
                forward[j] = np.where(better, value, forward[j])
                back[j] = np.where(better, size, back[j])
        rows = np.arange(n)
        behind = np.full((width + 1, n), -np.inf)
        behind[own, rows] = 0
        for i in range(width - 1, -1, -1):
            for size in range(1, min(self.longest, width - i) + 1):
                np.maximum(behind[i], self.score[piece[i, size]] + behind[i + size], out=behind[i])
        taken = np.zeros((width, n), np.int64)
        path = np.full((width, n), -1, np.int32)
        at = np.where(unknown, 0, own)
        table = np.full((width, self.longest + 1, n), -1, np.int32)
        for (i, size), p in piece.items():
            table[i, size] = p
        while (open_ := np.flatnonzero(at > 0)).size:
            size = back[at[open_], open_]
            at[open_] -= size
            taken[at[open_], open_] = size
            path[at[open_], open_] = table[at[open_], size, open_]
        second = np.full(n, -np.inf)
        for (i, size), p in piece.items():
            value = forward[i] + self.score[p] + behind[i + size]
            np.maximum(second, np.where(taken[i] == size, -np.inf, value), out=second)
        good = np.flatnonzero(~unknown)
        best[where[good]] = forward[own[good], good]
        gap[where[good]] = best[where[good]] - second[good]
        for k in good:
            column = path[:, k]
            ids[where[k]] = column[column >= 0]
        return list(where[unknown])

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Piece ids of the words in order."""
        count = self.count[numbers]
        ends = np.cumsum(count)
        inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)
        return self.flat[np.repeat(self.start[numbers], count) + inside]

    def text_nbest(self, words: list[str], numbers: np.ndarray, n: int) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        """The ``n`` best segmentations of a text: score, and the ids of the words (by place) that differ from the best.

        A segmentation that changes another word than the ``n - 1`` with the smallest gaps loses at least as much as
        each of those changes by itself, so the ``n`` best are found among these words.
        """
        total = float(self.best[numbers].sum())
        gaps = self.gap[numbers]
        near = np.argpartition(gaps, n - 1)[: n - 1] if len(gaps) > n else np.arange(len(gaps))
        out: list[tuple[float, dict]] = [(0.0, {})]
        for place in sorted(int(k) for k in near if np.isfinite(gaps[k])):
            word = words[place]
            if word not in self.several:
                self.several[word] = nbest(self.vocab, word, n)
            listed = self.several[word]
            out = heapq.nsmallest(n, (
                (loss + listed[0][0] - score, changed | ({place: ids} if k else {}))
                for loss, changed in out for k, (score, ids) in enumerate(listed)
            ), key=lambda x: x[0])
        return [(total - loss, changed) for loss, changed in out]


def decode_ids(vocab: Vocabulary, ids: Sequence[int]) -> str:
    """The text of piece ids: marks become spaces, the leading one goes, bytes are joined as UTF-8."""
    text = b"".join(map(vocab.surface.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text", n: int = NBEST) -> DataFrame:
    """``<key>, ids, n_pieces, scores, others, round_trip`` of each row of ``docs``.

    ``ids`` is the best segmentation, ``scores`` the scores of the up to ``n`` best in falling order. ``others`` has the
    segmentations behind the best as changes of it: from place ``at`` of ``ids``, ``cut`` ids give way to ``ids``
    (``segmentations`` puts them together). ``round_trip`` tells that decoding ``ids`` gives the text. A null or empty text has no pieces, one segmentation of score 0, and
    makes the round trip. A mark (U+2581) in a text is read as a space, as the format has it. Rows that repeat each get
    their row; other columns are not read. A task holds one slice of texts and a bounded table of words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    rows = over_cores(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    kind = docs.schema[key].dataType.simpleString()
    changes = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("cut", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        words_of = Segmenter(known)
        for batch in slices(batches, "text", 2 << 20):
            if len(words_of.index) > REMEMBERED:
                words_of.forget()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            split = [split_words(t) for t in texts]
            numbers = [words_of.numbers(w) for w in split]
            words_of.settle()
            flat, scores, others, same = [], [], [], []
            for t, w, k in zip(texts, split, numbers, strict=True):
                ids = words_of.ids(k)
                flat.append(ids)
                listed = words_of.text_nbest(w, k, n)
                scores.append([s for s, _ in listed])
                ends = np.cumsum(words_of.count[k])
                others.append([
                    [{"at": int(ends[p] - words_of.count[k[p]]), "cut": int(words_of.count[k[p]]), "ids": new} for p, new in sorted(changed.items())]
                    for _, changed in listed[1:]
                ])
                same.append(decode_ids(known, ids.tolist()) == t.replace(SPACE, " "))
            counts = np.fromiter(map(len, flat), np.int64, len(flat))
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
                    pa.array(counts), pa.array(scores, pa.list_(pa.float64())), pa.array(others, changes), pa.array(same, pa.bool_()),
                ],
                ["key", "ids", "n_pieces", "scores", "others", "round_trip"],
            )

    others = "others array<array<struct<at: int, cut: int, ids: array<int>>>>"
    out = rows.mapInArrow(encoded, f"key {kind}, ids array<int>, n_pieces long, scores array<double>, {others}, round_trip boolean")
    return out.select(F.col("key").alias(key), "ids", "n_pieces", "scores", "others", "round_trip")


def segmentations(ids: Sequence[int], others: Sequence[Sequence]) -> list[list[int]]:
    """The ids of all segmentations of one row of ``encode``, best first."""
    out = [list(ids)]
    for changes in others:
        changed, moved = list(ids), 0
        for at, cut, new in changes:
            changed[at + moved : at + moved + cut] = new
            moved += len(new) - cut
        out.append(changed)
    return out


def decode(encoded: DataFrame, vocab: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``<key>, text`` of rows with piece ids; null ids are an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocab)
    kind = encoded.schema[key].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(shared.value, row.as_py() or []) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    out = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(decoded, f"key {kind}, text string")
    return out.select(F.col("key").alias(key), "text")

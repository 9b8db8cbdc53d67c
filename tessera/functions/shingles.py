"""Sketches of token lists in Arrow batches: the MD5 of all shingles of many units at once, as array arithmetic.

The hashes are those of ``md5(array_join(slice(tokens, i, 5), ' '))``. One call per shingle, in Spark or in Python, costs
several times the arithmetic of the hash itself, and a corpus has about as many shingles as words.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from tessera.functions.text import MIN_TOKENS, SHINGLE_WIDTH, SKETCH_SIZE, WHITESPACE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens whose shingles are hashed together, shingles in one run of the arithmetic, blocks of the longest such shingle.
#: A run is long, since a call on a short array takes more time than its arithmetic.
CHUNK_TOKENS, RUN_SHINGLES, MOST_BLOCKS = 1 << 17, 1 << 14, 8
#: Bytes of text that are cut into tokens together.
CHUNK_BYTES = 1 << 20
_IS_SPACE = np.isin(np.arange(256), list(WHITESPACE.encode()))
_SPACED = np.where(_IS_SPACE, ord(" "), np.arange(256)).astype(np.uint8)
_IS_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))


def _add_block(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """The MD5 states after one more block of each message; ``words`` is 16 rows of numbers."""
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            mixed, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += words[at]
        mixed += _SINES[i]
        shift = _SHIFTS[i // 16][i % 4]
        turned = mixed << np.uint32(shift)
        mixed >>= np.uint32(32 - shift)
        turned |= mixed
        turned += b
        a, d, c, b = d, c, b, turned
    return [x + y for x, y in zip(state, (a, b, c, d))]


def _padding(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size of a message of ``n`` blocks: which bits of them it keeps, and what stands behind it."""
    sizes, at = np.arange(64 * n - 8), np.arange(64 * n)
    keeps = np.where(at < sizes[:, None], 255, 0).astype(np.uint8).view("<u8")
    behind = np.where(at == sizes[:, None], 0x80, 0).astype(np.uint8).view("<u8")
    behind[:, -1] = sizes * 8
    return keeps, behind


def md5_of_ranges(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MD5 digests, 16 bytes a row, of ``data[start : start + size]`` for each range of the bytes ``data``."""
    digests = np.empty((len(starts), 4), "<u4")
    blocks = (sizes + 8) // 64 + 1
    padded = np.concatenate((data, np.zeros(64 * MOST_BLOCKS, np.uint8)))
    for n in range(1, MOST_BLOCKS + 1):
        of_size = np.flatnonzero(blocks == n)
        windows = np.lib.stride_tricks.sliding_window_view(padded, 64 * n)
        keeps, behind = _padding(n) if len(of_size) else (None, None)
        for i in range(0, len(of_size), RUN_SHINGLES):
            rows = of_size[i : i + RUN_SHINGLES]
            size = sizes[rows]
            messages = windows[starts[rows]].view("<u8") & keeps[size] | behind[size]
            words = np.ascontiguousarray(messages.view("<u4").T)
            state = [np.full(len(rows), x, np.uint32) for x in _START]
            for k in range(n):
                state = _add_block(state, words[16 * k : 16 * k + 16])
            digests[rows] = np.stack(state, axis=1)
    whole = digests.view(np.uint8)
    for row in np.flatnonzero(blocks > MOST_BLOCKS):
        message = data[starts[row] : starts[row] + sizes[row]].tobytes()
        whole[row] = np.frombuffer(hashlib.md5(message, usedforsecurity=False).digest(), np.uint8)
    return whole


def _smallest(digests: np.ndarray) -> np.ndarray:
    """The ``SKETCH_SIZE`` smallest digests in order, cut before distinct."""
    halves = digests.view(">u8")
    high = halves[:, 0].astype(np.uint64)
    near = np.arange(len(high))
    if len(high) > SKETCH_SIZE:
        near = np.flatnonzero(high <= np.partition(high, SKETCH_SIZE - 1)[SKETCH_SIZE - 1])
    order = near[np.lexsort((halves[near, 1], high[near]))][:SKETCH_SIZE]
    found = halves[order]
    new = np.concatenate(([True], (found[1:] != found[:-1]).any(axis=1)))
    return digests[order[new]]


def _sketches(data: np.ndarray, places: np.ndarray, lengths: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The sketches of units with the ``n`` tokens from the ``first`` on; a token is ``lengths`` bytes of ``data`` from
    ``places``, and one space follows it inside of a unit."""
    shingles = n - (SHINGLE_WIDTH - 1)
    ends = np.cumsum(shingles)
    at = np.arange(shingles.sum()) + np.repeat(first - (ends - shingles), shingles)
    last = at + SHINGLE_WIDTH - 1
    digests = md5_of_ranges(data, places[at], places[last] + lengths[last] - places[at])
    return [_smallest(digests[end - size : end]) for size, end in zip(shingles, ends)]


def _hexed(found: list[np.ndarray], sizes: np.ndarray, missing: np.ndarray) -> pa.ListArray:
    flat = np.concatenate(found) if found else np.zeros((0, 16), np.uint8)
    hexes = pa.py_buffer(flat.tobytes().hex().encode())
    values = pa.StringArray.from_buffers(len(flat), pa.py_buffer(np.arange(len(flat) + 1, dtype=np.int32) * 32), hexes)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.append(missing, False))
    return pa.ListArray.from_arrays(offsets, values)


def sketches_of(tokens: pa.ListArray) -> pa.ListArray:
    """The sketch of each list of at least ``SHINGLE_WIDTH`` tokens, as sorted hex hashes; null for a null list."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
    found, sizes = [], np.zeros(len(tokens), np.int64)
    begin = 0
    while begin < len(tokens):
        # As many rows as fit a chunk; a longer row is a chunk of its own.
        fits = int(np.searchsorted(np.cumsum(counts[begin:]), CHUNK_TOKENS, "right"))
        rows = tokens.slice(begin, max(1, fits))
        kept = np.flatnonzero(counts[begin : begin + len(rows)])
        if len(kept):
            n = counts[begin + kept]
            joined = pc.binary_join(rows.drop_null(), " ").cast(pa.large_binary())
            offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
            data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
            lengths = np.asarray(pc.binary_length(rows.flatten()), np.int64)
            # A token begins after those before it, with a space behind each but the last of a row.
            places = offsets[0] + np.cumsum(lengths) - lengths + np.arange(len(lengths)) - np.repeat(np.arange(len(n)), n)
            found += _sketches(data, places, lengths, np.cumsum(n) - n, n)
            sizes[begin + kept] = [len(x) for x in found[len(found) - len(kept) :]]
        begin += len(rows)
    return _hexed(found, sizes, counts == 0)


def _positions(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``starts``, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of ``text_tokens`` in each text: ``data, places, lengths`` as in ``_sketches``, and counts by text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = _IS_SPACE[data]
    begins, closes = ~space, ~space
    begins[1:] &= space[:-1]
    closes[:-1] &= space[1:]
    filled = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[heads], closes[tails] = ~space[heads], ~space[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    lengths = ends - starts
    inner = ends < np.repeat(offsets[1:], counts)
    kept, spaced = ~space, _SPACED[data]
    kept[ends[inner]] = True
    # Numbers are digits only, or digits around one point.
    maybe = np.flatnonzero(_IS_DIGIT[data[starts]] & _IS_DIGIT[data[ends - 1]])
    if len(maybe):
        size = lengths[maybe]
        inside, heads = data[_positions(starts[maybe], size)], np.cumsum(size) - size
        digits, points = (np.add.reduceat(x, heads, dtype=np.int64) for x in (_IS_DIGIT[inside], inside == ord(".")))
        numbers = maybe[(digits + points == size) & (points <= 1)]
        kept[_positions(starts[numbers], lengths[numbers])] = False
        kept[starts[numbers]], spaced[starts[numbers]], lengths[numbers] = True, ord("0"), 1
    taken = lengths + inner
    return spaced[kept], np.cumsum(taken) - taken, lengths, counts


def sketches_of_texts(texts: pa.Array) -> tuple[pa.Array, pa.ListArray]:
    """For each text the number of its tokens, null for a null text, and its sketch, null with fewer than ``MIN_TOKENS``."""
    nbytes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    found, sizes, counts = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    begin = 0
    while begin < len(texts):
        fits = int(np.searchsorted(np.cumsum(nbytes[begin:]), CHUNK_BYTES, "right"))
        rows = texts.slice(begin, max(1, fits))
        data, places, lengths, n = tokens_of(rows)
        counts[begin : begin + len(rows)] = n
        usable = np.flatnonzero(n >= MIN_TOKENS)
        if len(usable):
            found += _sketches(data, places, lengths, (np.cumsum(n) - n)[usable], n[usable])
            sizes[begin + usable] = [len(x) for x in found[len(found) - len(usable) :]]
        begin += len(rows)
    missing = np.asarray(pc.is_null(texts))
    return pa.array(counts, pa.int32(), mask=missing), _hexed(found, sizes, counts < MIN_TOKENS)


def with_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``key, n_tokens, tokens`` to ``key, n_tokens, fp``."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), sketches_of(batch.column(2))], ["key", "n_tokens", "fp"]
        )


def with_text_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``key, text`` to ``key, n_tokens, fp``."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *sketches_of_texts(batch.column(1))], ["key", "n_tokens", "fp"])

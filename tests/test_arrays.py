"""The array forms of the sketch, the matcher and the profile join against plain ones."""

import hashlib
import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

import brute
from tessera.functions import shingles
from tessera.functions.text import text_tokens
from tessera.operators import extract, neardup
from tessera.operators.scoring import SecondText, _score_batches


def test_ratio_equals_the_matcher():
    rng = random.Random(5)

    def changed(text):
        chars = list(text)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(chars) + 1)
            chars[at : at + rng.randint(0, 9)] = rng.choices("abcxyz \né\U0001f600", k=rng.randint(0, 9))
        return "".join(chars)

    for _ in range(400):
        letters = rng.choice(["ab", "abcd ", "etaoin shrdlu qzxj", "abcdefghijklmnopqrstuvwxyz .,\né\U0001f600"])
        a = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 40, 199, 200, 260, 700])))
        b = changed(a) if rng.random() < 0.7 else "".join(rng.choices(letters, k=rng.choice([0, 3, 150, 300])))
        for autojunk in (True, False):
            assert SecondText(b, autojunk).ratio(a) == SequenceMatcher(None, a, b, autojunk).ratio()


def test_pairs_below_need_get_no_ratio():
    a, b = "spam and eggs", "spam or eggs"
    rows = [
        {"ta": "1", "tb": "2", "a": 1, "b": 2, "text_a": a, "text_b": b, "forward": True, "backward": True, "need": need}
        for need in (0.0, 0.9999)
    ]
    (out,) = _score_batches(iter([pa.RecordBatch.from_pylist(rows)]), True)
    both = [SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()]
    assert [out.column(c).to_pylist() for c in ("r_forward", "r_backward")] == [[both[0], None], [both[1], None]]


@pytest.mark.parametrize("chunk", [50, 1000, 1 << 17])
def test_sketches_equal_plain_hashes(monkeypatch, chunk):
    monkeypatch.setattr(shingles, "CHUNK_TOKENS", chunk)
    rng = random.Random(chunk)

    def unit():
        words = ["".join(rng.choices("abcé\U0001f600 \x00z", k=rng.choice([0, 1, 7, 9, 30, 90, 300]))) for _ in range(rng.choice([2, 20, 500]))]
        return rng.choices(words, k=rng.choice([25, 30, 60, 400, 3000]))

    units = [None, *(unit() if rng.random() < 0.8 else None for _ in range(40)), None]
    rows = pa.array([["x"] * 30, *units], pa.list_(pa.string())).slice(1)
    assert shingles.sketches_of(rows).to_pylist() == [t and sorted(brute.sketch(t)) for t in units]


@pytest.mark.parametrize("chunk", [1, 50, 1 << 20])
def test_texts_are_cut_where_they_are_hashed(spark, monkeypatch, chunk):
    """Counts and sketches of texts as of their lists of tokens: numbers, all white space, nulls, several bytes a letter."""
    rng = random.Random(chunk)
    parts = ["a", "bc", "é", "1", "23", "4.5", ".", "1.2.3", "7.", ".7", " ", "  ", "\n", "\t", "\r", "\x0b", "\u00a0", "\U0001f600", " 12 "]
    texts = [None, "", " ", "\n", *("".join(rng.choices(parts, k=rng.choice([1, 30, 100, 600]))) for _ in range(60)), " x 3 ", None]
    units = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    tokens = [r.tokens for r in units.select("key", text_tokens(units.text).alias("tokens")).orderBy("key").collect()]
    monkeypatch.setattr(shingles, "CHUNK_BYTES", chunk)
    n, sketches = shingles.sketches_of_texts(pa.array(["before 1", *texts]).slice(1))
    assert n.to_pylist() == [None if t is None else len(t) for t in tokens]
    assert sketches.to_pylist() == [sorted(brute.sketch(t)) if t and len(t) >= 25 else None for t in tokens]
    found = neardup.sketch_units(units).orderBy("key").collect()
    plain = neardup.sketch_units(units.select("key", text_tokens(units.text).alias("tokens"))).orderBy("key").collect()
    assert found == plain


def test_sizes_around_the_border_of_a_block():
    import numpy as np

    data = np.frombuffer(bytes(range(256)) * 4, np.uint8)
    sizes = np.arange(0, 700)
    starts = np.arange(700) % 300
    found = shingles.md5_of_ranges(data, starts, sizes)
    assert [x.tobytes() for x in found] == [hashlib.md5(data[s : s + n].tobytes()).digest() for s, n in zip(starts, sizes)]


@pytest.mark.parametrize(("rows", "hashes"), [(1_000, 1_024), (3, 4)])
def test_profiles_that_meet_in_a_hash(spark, monkeypatch, rows, hashes):
    """Each gated pair once, at its first common hash, however the profiles of a hash are cut."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(neardup, "CELL_HASHES", hashes)
    rng = random.Random(rows)
    hot = {pid: sorted(rng.sample(range(25), rng.randint(4, 12))) for pid in range(30)}
    n = {pid: len(h) + rng.randint(0, 6) for pid, h in hot.items()}
    posts = [(h, p, n[p], hot[p], at) for p in hot for at, h in enumerate(hot[p])]
    found = neardup._profile_overlaps(spark.createDataFrame(posts, "h long, pid long, n int, hot array<long>, at int"))
    common = {(a, b): len({*hot[a]} & {*hot[b]}) for a in hot for b in hot if a < b}
    expected = [(a, b, n[a], n[b], c) for (a, b), c in common.items() if c and c * 13 >= (n[a] + n[b]) * 3]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_facts_leave_in_small_batches():
    """A worker holds the facts of some files only, not those of a whole batch of input."""
    files = pa.RecordBatch.from_pydict({"path": [f"/{i}.py" for i in range(40)], "content": ["def f():\n" + "    x = 1\n" * 5_000] * 40})
    found = list(extract.facts_of(iter([files]), "PERMISSIVE"))
    assert sum(len(b) for b in found) == 40
    assert max(sum(len(s) for s in b.column("source").to_pylist()) for b in found) <= 2 * extract._FLUSH_CHARS <= 1_000_000

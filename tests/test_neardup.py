import hashlib
import os
import random
import re
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from tessera.functions.text import text_tokens
from tessera.operators.neardup import best_by_sketch, build_index, pair_groups, partner_counts, partners_of, sketch_pairs
from tessera.operators import neardup, scoring
from tessera.operators.scoring import Texts, best_by_text, common_length, ratio_bounds, successors
from tessera.session import checkpoint_root, stage


def corpus(seed, units=60, words=400):
    """Copies, near copies of a few templates, texts with a shared header, and unrelated ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    templates, header = [fresh(60) for _ in range(3)], fresh(24)
    texts = []
    for _ in range(units):
        kind = rng.random()
        if kind < 0.35:
            texts.append(list(rng.choice(templates)))
        elif kind < 0.7:
            text = list(rng.choice(templates))
            for _ in range(rng.randrange(1, 6)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            texts.append(text)
        elif kind < 0.85:
            texts.append(header + fresh(40))
        else:
            texts.append(fresh(rng.choice((20, 24, 25, 50))))
    # The same tokens in another layout: equal sketch, different text.
    return {k: rng.choice((" ", " ", "\n")).join(t) for k, t in enumerate(texts)}


def units_of(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "key long, source string")
    return rows, rows.select("key", text_tokens(F.col("source")).alias("tokens"))


def sketches_of(texts):
    number = re.compile(r"[0-9]+(\.[0-9]+)?")
    return {k: brute.sketch(["0" if number.fullmatch(w) else w for w in t.split()]) for k, t in texts.items()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limits", ["default", "tiny"])
def test_best_matches_equal_brute_force(spark, request, seed, limits):
    if limits == "tiny":
        request.getfixturevalue("tiny_limits")
    texts = corpus(seed)
    sources, units = units_of(spark, texts)
    index = build_index(units)
    if limits == "tiny":
        assert not index.profiles.isEmpty()
    expected = brute.best_by_jaccard(sketches_of(texts))
    by_sketch = best_by_sketch(index)
    found = {r["key"]: (r["score"], r["partner"]) for r in by_sketch.collect()}
    assert found == expected

    by_text = best_by_text(index, sources, by_sketch)
    found = {r["key"]: (r["score"], r["partner"]) for r in by_text.collect()}
    assert found == brute.best_by_ratio(sketches_of(texts), texts)


@pytest.mark.parametrize("limits", ["default", "tiny"])
def test_pairs_are_those_of_distinct_sketches(spark, request, limits):
    if limits == "tiny":
        request.getfixturevalue("tiny_limits")
    texts = corpus(3)
    sketches, first = sketches_of(texts), {}
    for key in sorted(sketches):
        first.setdefault(sketches[key], key)
    expected = {(a, b): j for a, b, j in brute.gated({k: s for s, k in first.items()})}
    rows = sketch_pairs(build_index(units_of(spark, texts)[1])).collect()
    assert len(rows) == len(expected)
    assert {(r["a"], r["b"]): r["jaccard"] for r in rows} == expected


@pytest.mark.parametrize("limits", ["default", "tiny"])
def test_factorised_pairs_imply_every_pair(spark, request, limits):
    if limits == "tiny":
        request.getfixturevalue("tiny_limits")
    texts = corpus(5)
    pairs = {(a, b): j for a, b, j in brute.gated(sketches_of(texts))}
    units = units_of(spark, texts)[1]
    found = pair_groups(build_index(units))
    group, members = {}, {}
    for r in found.members.collect():
        group[r["key"]] = r["group"]
        members.setdefault(r["group"], []).append(r["key"])
    implied = {}
    for r in found.links.collect():
        listed = {(min(x, y), max(x, y)) for x in members[r["a"]] for y in members[r["b"]] if x != y}
        assert len(listed) == r["pairs"] and not listed & set(implied)
        assert (r["size_a"], r["size_b"]) == (len(members[r["a"]]), len(members[r["b"]]))
        implied |= dict.fromkeys(listed, r["jaccard"])
    assert implied == pairs and found.links.count() < len(pairs)
    counts = {r["key"]: r["n_links"] for r in partner_counts(found).collect()}
    assert counts == {k: sum(k in p for p in pairs) for k in group}

    asked = list(range(0, 80, 3))
    rows = partners_of(found, spark.createDataFrame([(k,) for k in asked], "key long")).collect()
    both = pairs | {(b, a): j for (a, b), j in pairs.items()}
    assert sorted((r["key"], r["partner"], r["jaccard"]) for r in rows) == sorted((a, b, j) for (a, b), j in both.items() if a in asked)


@pytest.mark.parametrize("limits", ["default", "tiny"])
def test_only_what_is_asked_for_is_linked(spark, request, monkeypatch, limits):
    """With asked units no link between two other groups is made, and no list of links is written before it is wanted."""
    if limits == "tiny":
        request.getfixturevalue("tiny_limits")
    texts = corpus(9)
    pairs = {(a, b): j for a, b, j in brute.gated(sketches_of(texts))}
    index = build_index(units_of(spark, texts)[1])
    asked, written = [4, 11, 30], []
    asking = spark.createDataFrame([(k,) for k in [*asked, 4, 999]], "key long")
    stage = neardup.stage
    monkeypatch.setattr(neardup, "stage", lambda df, label: (written.append(df.columns), stage(df, label))[1])
    found = pair_groups(index, asking)
    assert not any("inter" in columns for columns in written)
    group = {r["key"]: r["group"] for r in found.members.collect()}
    wanted = {group[k] for k in asked if k in group}
    links = [(r["a"], r["b"]) for r in found.links.collect()]
    every = {tuple(sorted((group[a], group[b]))) for a, b in pairs}
    assert len(links) == len(set(links)) and {x for x in every if wanted & set(x)} == {tuple(sorted(x)) for x in links} != every
    assert {r["group"]: r["n_links"] for r in found.groups.collect()} == {
        g: sum(g in p for p in pairs) for g in wanted
    }  # a group is named by its smallest key, so its own pairs are those of that key
    rows = partners_of(found, asking).collect()
    expected = {(x, y): j for p, j in pairs.items() for x, y in (p, p[::-1]) if x in asked}
    assert {(r["key"], r["partner"]): r["jaccard"] for r in rows} == expected and len(rows) == len(expected)


def test_text_of_frequent_characters_only(spark):
    """With 200 characters or more and none of them rare, the matcher finds no more than a common beginning."""
    plain = " ".join(["ab ba aab"] * 40)
    rare = " ".join(["ab ba aab"] * 39) + " xyz ab ba"
    texts = {1: plain, 2: plain, 3: rare, 4: plain, 5: rare, 6: plain.replace(" ", "\n")}
    sources, units = units_of(spark, texts)
    index = build_index(units)
    found = {r["key"]: (r["score"], r["partner"]) for r in best_by_text(index, sources, best_by_sketch(index)).collect()}
    assert found == brute.best_by_ratio(sketches_of(texts), texts)


@pytest.mark.parametrize("limits", ["default", "tiny"])
def test_successors(spark, request, limits):
    if limits == "tiny":
        request.getfixturevalue("tiny_limits")
    members = [(k, t) for t in "xy" for k in range(0, 40, 3 if t == "x" else 7)]
    asks = [(k + 0, t) for t in "xy" for k in range(1, 40, 2)]
    asks = [(k, t) for k, t in asks if (k, t) not in members]
    found = successors(
        spark.createDataFrame(asks, "key long, text_id string"), spark.createDataFrame(members, "key long, text_id string")
    ).collect()
    expected = {(k, t): min((m for m, u in members if u == t and m > k), default=None) for k, t in asks}
    assert {(r["key"], r["text_id"]): r["next"] for r in found} == expected


def test_successors_move_each_row_once(spark):
    """One copied text with many members, asked many times: the answer is a join of nothing but the rows given."""
    members = spark.range(0, 60_000, 2).select(F.col("id").alias("key"), F.lit("x").alias("text_id"))
    asks = spark.range(1, 60_000, 2).select(F.col("id").alias("key"), F.lit("x").alias("text_id"))
    found = successors(asks, members)
    assert found.filter(F.coalesce("next", F.lit(60_000)) != F.col("key") + 1).isEmpty() and found.count() == 30_000
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Generate" not in plan and "SortMergeJoin" not in plan


def test_result_does_not_depend_on_partitioning(spark):
    texts = corpus(4)
    _, units = units_of(spark, texts)
    one = best_by_sketch(build_index(units.coalesce(1)))
    many = best_by_sketch(build_index(units.repartition(13)))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_no_units_at_all(spark):
    sources, units = units_of(spark, {1: "too short"})
    index = build_index(units)
    by_sketch = best_by_sketch(index)
    assert by_sketch.isEmpty() and sketch_pairs(index).isEmpty()
    assert best_by_text(index, sources, by_sketch).isEmpty()


@settings(max_examples=100, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.integers(0, 60), min_size=1, max_size=50), st.sets(st.integers(0, 60), min_size=1, max_size=50))
def test_prefix_rule(a, b):
    """A pair at the gate shares an element of both prefixes; the rule the join relies on."""
    needed = lambda s: (3 * len(s) + 9) // 10
    prefix = lambda s: set(sorted(s)[: len(s) - needed(s) + 1])
    if len(a & b) / len(a | b) >= 0.3:
        assert min(a & b) in prefix(a) & prefix(b)
        assert min(len(a), len(b)) >= needed(a | b) or min(len(a), len(b)) * 10 >= 3 * max(len(a), len(b))


def one_template(n, seed=7):
    """Functions that differ only in their numbers: the tokens, and so the sketches, are equal."""
    rng = random.Random(seed)
    texts = {}
    for key in range(n):
        v = [rng.randrange(10 ** rng.randrange(1, 6)) for _ in range(8)]
        texts[key] = (
            f"def load_settings(path, retries = {v[0]} ):\n    \"\"\"Read settings from PATH.\"\"\"\n    LIMIT = {v[1]}\n"
            f"    TIMEOUT_MS = {v[2]}\n    with open(path) as handle:\n        data = json.load(handle)\n"
            f"    if len(data) > {v[3]} and retries < {v[4]} :\n        raise ValueError('too many keys: %d' % len(data))\n"
            f"    for key, value in sorted(data.items()):\n        Config.set(key.upper(), value * {v[5]} + {v[6]} )\n"
            f"    return Config(LIMIT, TIMEOUT_MS, [ {v[7]} ])\n"
        )
    return texts


def scored_pairs(spark, monkeypatch, texts, **limits):
    """Best partners, and how many pairs went through the matcher."""
    n, plain = [0], scoring.score_pairs

    def counted(pairs, bodies, autojunk=True):
        out = plain(pairs, bodies, autojunk)
        n[0] += out.filter("coalesce(r_forward, r_backward) is not null").count()
        return out

    with monkeypatch.context() as patched:
        patched.setattr(scoring, "score_pairs", counted)
        for name, value in limits.items():
            patched.setattr(scoring, name, value)
        sources, units = units_of(spark, texts)
        index = build_index(units)
        rows = best_by_text(index, sources, best_by_sketch(index)).collect()
    return {r["key"]: (r["score"], r["partner"]) for r in rows}, n[0]


def test_one_template_scores_fewer_pairs_than_it_has(spark, monkeypatch):
    """Scored pairs grow clearly slower than the pairs, and no winner is lost."""
    share = {}
    for size in (100, 200, 400):
        texts = one_template(size)
        found, scored = scored_pairs(spark, monkeypatch, texts)
        pairs = size * (size - 1) // 2
        share[size] = scored / pairs
        print(f"{size} texts, {pairs} pairs, {scored} scored")
        if size == 100:
            assert found == brute.best_by_ratio(sketches_of(texts), texts)
    assert share[400] < 0.8 * share[200] < 0.7 * share[100] and share[400] < 0.25


@pytest.mark.parametrize("seed", [5, 6])
def test_best_first_in_small_cells_equals_brute_force(spark, monkeypatch, tiny_limits, seed):
    """Copied texts, blocks of a few texts and of a few characters, and texts that the matcher does not find again."""
    rng = random.Random(seed)
    texts = one_template(24, seed)
    texts |= {100 + k: texts[rng.randrange(24)] for k in range(6)}
    texts |= {200 + k: " ".join(rng.choice(("ab", "ba", "aab")) + rng.choice(("", "", "\n")) for _ in range(90)) for k in range(3)}
    plain = " ".join(["ab ba aab"] * 40)
    texts |= {300 + k: plain.replace(" ", "\n", k % 4) for k in range(9)}
    limits = {"FEW_TEXTS": 3, "CELL_ROWS": 5, "CELL_CHARS": 1 << 11, "PARTNERS": 2}
    found, _ = scored_pairs(spark, monkeypatch, texts, **limits)
    assert found == brute.best_by_ratio(sketches_of(texts), texts)


words = st.lists(st.sampled_from(["ab", "ba", "xyz", "q", "1", "22", "é", "\n", "aab "]), max_size=90).map(" ".join)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(words.filter(bool), min_size=2, max_size=5), st.booleans())
def test_bounds_hold(texts, autojunk):
    own = Texts(texts, autojunk)
    yes = np.ones((len(texts), len(texts)), bool)
    bounds = ratio_bounds(own, own, yes, ~yes)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            ratio = SequenceMatcher(None, a, b, autojunk=autojunk).ratio()
            assert ratio <= bounds[i, j]
            assert ratio <= 2.0 * common_length(a, b) / (len(a) + len(b))
        assert SequenceMatcher(None, a, a, autojunk=autojunk).ratio() == 1


def test_common_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert common_length(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


@pytest.mark.parametrize("rows", [3, 1_000])
def test_hot_sketches_are_compared_in_cells(spark, monkeypatch, tiny_limits, rows):
    """Pairs and best partners equal brute force in small blocks too, and no pair of profiles is listed for them."""
    def listed(index):
        raise AssertionError("pairs of profiles are listed")

    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(neardup, "hot_profiles", listed)
    texts = corpus(5, units=40)
    sketches = sketches_of(texts)
    index = build_index(units_of(spark, texts)[1])
    assert not index.profiles.isEmpty()
    distinct = {s: k for k, s in sorted(sketches.items(), reverse=True) if s}
    expected = sorted((a, b) for a, b, _ in brute.gated({k: s for s, k in distinct.items()}))
    assert sorted((r.a, r.b) for r in sketch_pairs(index).collect()) == expected
    best = {r.key: (r.score, r.partner) for r in best_by_sketch(index).collect()}
    assert best == brute.best_by_jaccard(sketches)


def one_header(n, seed=3):
    """Functions with a common header and names of their own: different sketches that share the header's hashes only."""
    rng = random.Random(seed)
    texts = {}
    for key in range(n):
        names = [f"v{rng.randrange(1 << 32):08x}" for _ in range(rng.randrange(2, 5))]
        lines = "".join(f"    p = p and {name}\n" for name in names)
        texts[key] = f"def f ( p , q : int = 0 ) - > int :\n{lines}    return p\n"
    return texts


@pytest.mark.parametrize("rows", [16, 1_024])
def test_hot_sketches_score_few_of_their_pairs(spark, monkeypatch, tiny_limits, rows):
    """Texts whose sketches share hot hashes only: a pair is scored only if its common subsequence may still win."""
    texts = one_header(120)
    texts |= {200: texts[7], 201: texts[7], 202: texts[8].replace("    ", "\t"), 203: texts[9] * 3}
    sketches = sketches_of(texts)
    found, scored = scored_pairs(spark, monkeypatch, texts, HOT_ROWS=rows)
    assert found == brute.best_by_ratio(sketches, texts)
    pairs = sum(1 for _ in brute.gated(sketches))
    assert pairs > 4_000 and scored < 0.3 * pairs


def test_common_lengths_of_many_pairs(monkeypatch):
    """Words that fill up, empty texts, characters of one side only; and one by one where masks would be too large."""
    rng = random.Random(2)
    left, right = (["".join(rng.choice(some) for _ in range(rng.randrange(0, 200))) for _ in range(12)] for some in ("abcx", "abc\U0001f600y"))
    left += ["", "a" * 62, "a" * 124, "ab" * 62]
    right += ["", "a" * 62, "a" * 63, "ba" * 93]
    i, j = (x.ravel() for x in np.indices((len(left), len(right))))
    expected = [common_length(left[x], right[y]) for x, y in zip(i, j)]
    for at_once, most in ((8_192, 8 << 20), (33, 8 << 20), (33, 100)):
        monkeypatch.setattr(scoring, "PAIRS_AT_ONCE", at_once)
        monkeypatch.setattr(scoring, "MASK_WORDS", most)
        assert scoring.common_lengths(left, right, i, j).tolist() == expected
    assert scoring.common_lengths(left, right, i[:0], j[:0]).tolist() == []
    assert scoring.common_lengths(["x"], ["y"], np.zeros(1, int), np.zeros(1, int)).tolist() == [0]


def test_texts_are_kept_once_and_hashes_are_not_kept(spark, monkeypatch, tiny_limits):
    """What only the index needs is deleted with its end, and no text is written or the cold pairs are made a second time."""
    labels = []
    for module in (neardup, scoring):
        monkeypatch.setattr(module, "stage", lambda df, label, plain=module.stage: (labels.append(label), plain(df, label))[1])
    root = checkpoint_root(spark)
    before = set(os.listdir(root))
    texts = one_header(30)
    sources, units = units_of(spark, texts)
    index = build_index(units)
    assert not index.profiles.isEmpty()
    best = best_by_text(index, sources, best_by_sketch(index))
    assert {r["key"]: (r["score"], r["partner"]) for r in best.collect()} == brute.best_by_ratio(sketches_of(texts), texts)
    kept = {name.rpartition("-")[0] for name in set(os.listdir(root)) - before}
    assert "ranked" in kept and not kept & {"sketches", "postings", "frequency", "distinct"}
    assert labels.count("bodies") == labels.count("cold-pairs") == 1


def test_staging_leaves_no_shuffle_files(spark):
    """What was shuffled for a table goes with its writing; the session's own setting stays."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(name, "false")
    try:
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        held = lambda: {b.toString() for b in _java_list(manager.getAllBlocks()) if b.isShuffle()}
        before = held()
        made = stage(spark.range(1_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counted")
        for _ in range(50):
            if not held() - before:
                break
            time.sleep(0.1)
        assert not held() - before and made.agg(F.sum("count")).first()[0] == 1_000
        assert spark.conf.get(name) == "false"
    finally:
        spark.conf.unset(name)


def _java_list(blocks):
    return [blocks.apply(i) for i in range(blocks.size())]


def test_text_facts_are_those_of_column_expressions(spark):
    texts = [(1, "a e  (x)_y, z."), (2, ""), (3, None), (4, "é\U0001f600 eee\n")]
    rows = spark.createDataFrame([(k, k, t) for k, t in texts], "key long, sid long, source string")
    found = {r["key"]: (r["text_id"], r["chars"], r["counts"]) for r in scoring._text_facts(rows).collect()}
    for key, text in texts:
        counts = [None if text is None else text.count(c) for c in scoring.COUNTED_CHARS]
        expected = (None, None, [*counts, None]) if text is None else (hashlib.sha256(text.encode()).hexdigest(), len(text), [*counts, len(text) - sum(counts)])
        assert found[key] == expected


def test_pairs_of_rows_meet_over_batches(spark):
    """One row in a batch; a text with two rows makes two rows of its pair, and one without a row none."""
    texts = {1: "abcd xyz", 2: "abxd yz", 3: "zyx", 4: "zy x dcba"}
    bodies = spark.createDataFrame([*texts.items(), (3, texts[3])], "text_id long, source string")
    pairs = [(a, b, a, b, a < b, b < 4) for a in texts for b in (*texts, 5) if a != b]
    asked = spark.createDataFrame(pairs, "ta long, tb long, a long, b long, forward boolean, backward boolean")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "1")
    try:
        found = sorted(map(tuple, scoring.score_pairs(asked, bodies).collect()), key=str)
    finally:
        spark.conf.unset(name)
    ratio = lambda x, y: SequenceMatcher(None, texts[x], texts[y]).ratio()
    one = [(a, b, a, b, ratio(a, b) if f else None, ratio(b, a) if k else None) for a, b, _, _, f, k in pairs if b in texts]
    expected = [row for row in one for _ in range(2 if 3 in row[:2] else 1)]
    assert found == sorted(expected, key=str)

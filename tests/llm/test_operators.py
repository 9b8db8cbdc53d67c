"""The operators against brute force, round trips and held-out labels, and on null, empty, repeated and odd rows."""

import collections
import hashlib
import heapq
import itertools
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import archive, contain, dialogue, divergence, language, line_runs, minhash, mixing, pieces, quality, ranked, tiles, toxicity
from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, h1 int"


def docs_of(spark, texts, langs=None):
    """Documents with columns whose names also occur inside the operators."""
    rows = [
        (i if i != 99 else None, t, (langs or {}).get(i, "en"), "s" if i % 2 else None, len(t or ""), 1.0, "x", 7)
        for i, t in texts
    ]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (4, "one two"), (5, "word " * 30_000), (99, "null key here"), (6, "x|y é ▁ 😀\n")]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if hasattr(value, "as_tuple") else value


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, engine, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = engine.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall()) and found


def joined_components(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_code_lengths_follow_the_definition():
    texts = {"aa": [b"banana bandana", b"an"], "bb": [b"kiwi wiki"]}
    grams = {}
    for lang, own in texts.items():
        data = np.frombuffer(b"".join(own), np.uint8)
        grams[lang] = language.count_runs(np.cumsum([0, *map(len, own)]), data)
    trees = language.build_trees(grams, min_context=1)

    def cost(lang, context, byte):
        def counts(ctx):
            found = collections.Counter()
            for t in texts[lang]:
                padded = b"\n\n\n" + t
                for i in range(3, len(padded)):
                    if padded[i - len(ctx) : i] == ctx:
                        found[padded[i]] += 1
            return found

        p = np.full(256, 1 / 256)
        for k in range(4):
            c = counts(context[3 - k :])
            n, d = sum(c.values()), len(c)
            if n:
                left = sum(p[x] for x in range(256) if x not in c)
                p = np.array([c[x] / (n + d) if x in c else d / (n + d) * p[x] / left for x in range(256)])
        assert abs(p.sum() - 1) < 1e-9
        return -math.log2(p[byte])

    tried = [b"banana", b"", b"wi", b"q\xc3\xa9z band", b"kiwi"]
    offsets, data = np.cumsum([0, *map(len, tried)]), np.frombuffer(b"".join(tried), np.uint8)
    for window in (1 << 19, 3):
        bits = trees.bits(offsets, data, window)
        for at, t in enumerate(tried):
            padded = b"\n\n\n" + t
            for j, lang in enumerate(trees.languages):
                assert bits[at, j] == pytest.approx(sum(cost(lang, padded[i - 3 : i], padded[i]) for i in range(3, len(padded))), rel=1e-4)


def test_language_on_held_out_and_odd_rows(spark):
    found = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(known, on="doc_id")
    held = both[both.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()
    docs = docs_of(spark, [*ODD, (7, "123 456")])
    trees = language.fit_trees(docs, F.lit(True))
    rows = {(r.doc_id, r.lang_pred) for r in language.identify(docs, trees).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und"), (4, "en"), (None, "en")} <= rows
    assert language.identify(docs, trees).count() == len(ODD) + 1
    empty = docs.limit(0)
    assert language.identify(empty, language.fit_trees(empty, F.lit(True))).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.build_trees({})).collect()} == {"und"}


def test_no_language_is_lost_by_its_sample(spark):
    """A language whose only text is far above the budget is learned from the beginning of that text."""
    for key in range(100, 106):
        texts = [(i, "the cat sat on the mat and it was warm", "en") for i in range(50)]
        docs = spark.createDataFrame([*texts, (key, "der Hund liegt im Garten und schläft " * 900, "de"), (9, "", "fr")], "doc_id long, text string, lang string")
        trees = language.fit_trees(docs, F.lit(True), fit_bytes=3000)
        assert trees.languages == ["de", "en"]
        asked = spark.createDataFrame([(1, "der Hund schläft"), (2, "the cat was warm")], "doc_id long, text string")
        assert {(r.doc_id, r.lang_pred) for r in language.identify(asked, trees).collect()} == {(1, "de"), (2, "en")}


@pytest.mark.parametrize(("name", "label", "parts", "rest", "least"), [
    ("op2_quality", "quality", 5, 0, 0.93), ("op7_toxicity", "toxic", 4, 2, 0.93)])
def test_classifiers_on_held_out_rows(spark, name, label, parts, rest, least):
    found = QUERIES[name](spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = found[found.held_out].merge(labels, on="doc_id")
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % parts) == rest).all()
    assert ((held.score >= 0.3) == (held.predicted == 1)).all() and held.score.between(0, 1).all()
    assert (held.predicted == held[label]).mean() > least


def test_classifiers_on_odd_rows(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([Row(doc_id=4, quality=1, toxic=0), Row(doc_id=5, quality=None, toxic=None)])
    for fit, score in ((quality.fit, quality.score), (toxicity.fit, toxicity.score)):
        for used in (labels, labels.limit(0)):
            model = fit(docs, used, F.lit(True))
            rows = score(docs, model).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
            assert score(docs.limit(0), model).count() == 0
    kept = quality.keep(docs, quality.CompressionModel(b"\n" * 8, b"\n" * 8, (9.0, 0.0, 0.0, 0.0)), 0.3)
    assert kept.columns == docs.columns and kept.count() == len(ODD)


def test_swapped_identity_terms_move_the_score_less():
    terms = ("reds", "blues", "greens")
    rng = random.Random(1)
    texts = []
    for _ in range(300):
        toxic = rng.random() < 0.5
        who = "reds" if rng.random() < (0.9 if toxic else 0.1) else rng.choice(("blues", "greens"))
        texts.append((f"{who} are {'vile' if toxic and rng.random() < 0.8 else 'here'} {rng.choice('abcd')}", int(toxic)))

    def gap(penalty):
        w = toxicity.train(texts, 0.5, terms=terms, penalty=penalty)
        weights = dict(zip(w.features, w.weights, strict=True))
        return abs(weights["reds"] - weights["blues"]), weights["vile"]

    assert gap(50.0)[0] < 0.2 * gap(0.0)[0] and gap(50.0)[1] > 1


def test_line_runs_drop_lines(spark):
    texts = [*ODD, *((i, f"Shared  line\n own {i}\n\nSHARED  LINE \n") for i in range(20, 32)), *((i, "nine\nx") for i in range(40, 49))]
    out = {(r.row.doc_id, r.row.text): r for r in line_runs.drop_lines(docs_of(spark, texts), fanout=2).collect()}
    counts = collections.Counter()
    strip = " \t\n\x0b\x0c\r"
    for _, t in texts:
        counts.update({line.strip(strip).lower() for line in (t or "").split("\n")})
    for (_, t), r in out.items():
        lines = (t or "").split("\n")
        keep = [x for x in lines if not x.strip(strip).lower() or counts[x.strip(strip).lower()] < 10]
        assert r.n_lines == len(lines) and list(r.kept) == keep
    assert line_runs.drop_lines(docs_of(spark, texts)).count() == len(texts)
    assert line_runs.drop_lines(docs_of(spark, texts).limit(0)).count() == 0


def test_runs_count_like_one_group_by(spark):
    rng = random.Random(3)
    runs, total = line_runs.LineRuns(spark, min_documents=4, fanout=2), collections.Counter()
    for _ in range(5):
        batch = [(rng.randrange(12), 0) for _ in range(15)]
        total.update(batch)
        runs.add(spark.createDataFrame([(*k, True) for k in batch], "h1 long, h2 long, first boolean"))
    # Settled keys are counted on, so that the weights are the true ones.
    found = {(r.h1, r.h2): (r.n, r.n_lines) for r in runs.frequent().collect()}
    assert found == {k: (n, n) for k, n in total.items() if n >= 4}


def test_stored_runs_take_a_later_batch(spark, tmp_path):
    """Documents of an earlier call count, and a folder is gone on with by its own list of runs."""
    folder = str(tmp_path / "runs")
    first = docs_of(spark, [(i, f"common\nown {i}") for i in range(1, 7)])
    assert {tuple(r.kept) for r in line_runs.drop_lines(first, folder=folder).collect()} == {("common", f"own {i}") for i in range(1, 7)}
    later = docs_of(spark, [(i, f"COMMON \nnew {i}\ncommon") for i in range(11, 15)])
    assert {tuple(r.kept) for r in line_runs.drop_lines(later, folder=folder).collect()} == {(f"new {i}",) for i in range(11, 15)}
    again = line_runs.LineRuns(spark, folder)
    assert again.version == 2 * line_runs.BATCHES and {(r.n, r.n_lines) for r in again.frequent().collect()} == {(10, 14)}


def test_places_of_lines_in_a_long_text(spark):
    text = "\n".join(f"x{i % 700}" for i in range(30_000)) + "\n\n  "
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(line_runs.line_places(F.col("text"))).alias("x")).select("x.*").collect()
    assert sorted(r["at"] for r in rows) == list(range(30_000))
    assert sorted(r["at"] for r in rows if r["first"]) == list(range(700))


@pytest.mark.parametrize("limits", [(2000, 256), (3, 2)])
def test_minhash_equals_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(minhash, "SHARE", limits[0])
    monkeypatch.setattr(minhash, "CHUNK", limits[1])
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = list(ODD)
    for g in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for c in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 5) if c else 0):
                copy[rng.randrange(60)] = rng.choice(words)
            texts.append((100 + 12 * g + c, " ".join(copy).upper() if c % 2 else " ".join(copy)))
    out = minhash.near_duplicates(docs_of(spark, texts), k=3, percent=85).collect()
    sets = [(None if i == 99 else i, minhash.shingles(t or "", 3)) for i, t in texts]
    links = [
        (a, b) for (a, x), (b, y) in itertools.combinations(sets, 2)
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y)
    ]
    low = joined_components({a for a, _ in sets if a is not None}, links)
    expected = sorted((repr(a), len(x), low.get(a), a == low.get(a)) for a, x in sets)
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in out) == expected
    assert minhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * 0.25).tolist(), i % 2 if i % 7 else None) for i in range(240)]
    rows += [(500 + i, rows[1][1], 1) for i in range(5)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None, 1.0], 1), (604, [], 1), (605, [1.0, 2.0], 1), (606, [1.0, 2.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("copies", F.lit("x"))
    out = tiles.near_vectors(vectors, 0.93, block=32).collect()
    good = {i: (np.array(v), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda x, y: float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
    links = [
        (a, b) for a, b in itertools.combinations(good, 2)
        if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and cos(good[a][0], good[b][0]) >= 0.93
    ]
    count, low = collections.Counter(itertools.chain.from_iterable(links)), joined_components([r[0] for r in rows], links)
    assert links and sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == sorted(
        (i, count[i], low[i], low[i] == i) for i, _, _ in rows
    )
    assert tiles.near_vectors(vectors.limit(0), 0.93).count() == 0


def test_vectors_that_share_a_key(spark):
    """Two vectors of one key count their own links and are one node; 9 hangs on the second, 10 and 11 on neither."""
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 0.01]), (9, [0.01, 1.0]), (10, [-1.0, 0.0]), (11, [-1.0, 0.0]), (11, [-1.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, label string")
    for at in (vectors, vectors.orderBy(F.col("vec_id").desc()), vectors.repartition(4)):
        out = tiles.near_vectors(at, 0.93)
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect()) == [
            (7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 1, 7), (10, 2, 10), (11, 2, 10), (11, 2, 10),
        ]
    lone = spark.createDataFrame([(7, [1.0, 0.0], "x"), (7, [0.0, 1.0], "x"), (8, [1.0, 0.01], "x")], vectors.schema)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in tiles.near_vectors(lone, 0.93).collect()) == [(7, 0, 7), (7, 1, 7), (8, 1, 7)]


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_keys_equal_brute_force(spark, seed):
    """Keys drawn anew for each vector, so many stand for several; all vectors lie so near the threshold that some pairs are unsure."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 8))
    rows = [(int(rng.integers(0, 90)), (centres[i % 5] + rng.normal(size=8) * 0.3).tolist()) for i in range(150)]
    rows += [(95, rows[0][1]), (95, rows[1][1]), (rows[2][0], rows[2][1])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    cos = lambda x, y: float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if cos(rows[a][1], rows[b][1]) >= 0.93]
    count = collections.Counter(itertools.chain.from_iterable(links))
    low = joined_components([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    out = tiles.near_vectors(vectors, 0.93, block=16).collect()
    assert links and sorted((r.vec_id, r.n_links, r.component_id) for r in out) == sorted((i, count[at], low[i]) for at, (i, _) in enumerate(rows))


def test_quantisation_bounds_hold():
    x = np.random.default_rng(0).normal(size=(80, 33))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rounded = tiles.quantise(x)
    for threshold in (-0.2, 0.0, 0.1, 0.3):
        sure, unsure = tiles.tile(rounded, rounded, threshold)
        true = x @ x.T >= threshold
        assert not (sure & ~true).any() and not (true & ~(sure | unsure)).any()


def test_quality_rules_on_odd_rows(spark):
    rows = {r.doc_id: r for r in divergence.judge(docs_of(spark, [*ODD, (8, "a b c d a b c x")])).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept and rows[2].word_chars == 0
    assert rows[8].n_repeat_words == 6 and rows[5].n_repeat_words == 30_000 and rows[5].base_failed
    assert rows[6].n_symbols == 1 and len(rows) == 8
    assert divergence.judge(docs_of(spark, ODD).limit(0)).count() == 0


def small_vocabulary(bytes_too=False):
    plain = [("▁", -2.0), ("a", -1.1), ("b", -1.3), ("ab", -1.7), ("▁a", -2.4), ("ba", -2.05), ("bab", -2.9), ("aba", -3.3)]
    names = ["<unk>", *(p for p, _ in plain), *(f"<0x{b:02X}>" for b in range(256) if bytes_too)]
    byte_ids = list(range(len(plain) + 1, len(names))) if bytes_too else []
    return pieces.vocabulary([(p, i + 1, s) for i, (p, s) in enumerate(plain)], names, byte_ids, 0)


def every_segmentation(vocab, text):
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, min(len(text), vocab.longest) + 1):
        at = vocab.pieces.get(text[:k])
        if at is not None:
            out += [(float(vocab.scores[at]) + s, (at, *ids)) for s, ids in every_segmentation(vocab, text[k:])]
        elif k == 1:
            out += [(vocab.unknown_score + s, (vocab.unknown_id, *ids)) for s, ids in every_segmentation(vocab, text[1:])]
    return out


def test_nbest_equals_all_segmentations():
    vocab, rng = small_vocabulary(), random.Random(4)
    segmenter = pieces.Segmenter(vocab)
    for _ in range(60):
        text = "".join(rng.choice("aab b") for _ in range(rng.randrange(1, 11)))
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
        scores = sorted((s for s, _ in every_segmentation(vocab, marked)), reverse=True)[:5]
        assert [s for s, _ in pieces.nbest(vocab, marked, 5)] == pytest.approx(scores)
        words = pieces.split_words(text)
        numbers = segmenter.numbers(words)
        segmenter.settle()
        assert [s for s, _ in segmenter.text_nbest(words, numbers, 5)] == pytest.approx(scores)


def test_nbest_equals_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    form = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    vocab, model = small_vocabulary(), form.ModelProto()
    model.trainer_spec.model_type = 1
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.escape_whitespaces = True, True
    model.normalizer_spec.remove_extra_whitespaces = False
    for name, score, kind in [("<unk>", 0.0, 2), *((p, float(vocab.scores[i]), 1) for p, i in vocab.pieces.items())]:
        model.pieces.add(piece=name, score=score, type=kind)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ("abab ab", "bababa", "a bab aab"):
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
        theirs = [sum(vocab.scores[list(ids)]) for ids in library.nbest_encode_as_ids(text, nbest_size=3)]
        assert [s for s, _ in pieces.nbest(vocab, marked, 3)] == pytest.approx(theirs)


def test_pieces_round_trip(spark):
    docs = docs_of(spark, [*ODD, (7, "日本語 and a very" + "long" * 20 + "word\x00 end ")])
    vocab = pieces.load()
    encoded = pieces.encode(docs, vocab)
    rows = encoded.collect()
    assert len(rows) == len(ODD) + 1 and all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    assert all(list(r.scores) == sorted(r.scores, reverse=True) for r in rows)
    assert {r.doc_id: (r.n_pieces, list(r.scores)) for r in rows}[2] == (0, [0.0])
    back = {r.doc_id: r.text for r in pieces.decode(encoded, vocab).collect()}
    assert back[7].endswith("word\x00 end ") and back[1] == ""
    assert pieces.encode(docs.limit(0), vocab).count() == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 9), rng.choice(["a", "b", "b", "b", "c", None]), "en") for i in range(600)]
    rows += [(601, None, "empty", "en"), (602, "", "empty", "en"), (603, "tiny", "z", "en"), (603, "tiny", "z", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mix(docs, size=mixing.word_count(F.col("text"))).toPandas()
    assert len(out) == len(rows) and (out.taken <= 3 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
    for _, own in out.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max() and own.target.iloc[0] <= 3 * own.source_size.iloc[0]
    again = mixing.mix(docs, size=mixing.word_count(F.col("text"))).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a", long, "x"), (5, "http://b\r\nX: y", long, "x"), (5, "http://b\r\nX: y", long, "x"), (3, None, "short", "x"), (4, "u", "short", "x"), (6, "u", None, "x"), (None, "u", long, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    read_back = archive.restore(archive.write_archive(pages))
    found = sorted(repr((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.verified, bytes(r.payload).decode())) for r in read_back.collect())
    expected = [(1, "revisit", "5", 1200, True, long), (5, "response", None, 1200, True, long), (5, "response", None, 1200, True, long),
                (3, "response", None, 5, True, "short"), (4, "response", None, 5, True, "short"), (6, "response", None, 0, True, ""),
                (None, "revisit", "5", 1200, True, long)]
    assert found == sorted(map(repr, expected))
    archive.export_files(read_back.filter("record_id in (3, 4)"), str(tmp_path / "warc"))
    whole = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    assert whole.count(b"WARC/1.1\r\n") == 2 and whole.count(b"Content-Length: 5\r\n\r\nshort\r\n\r\n") == 2
    assert archive.restore(archive.write_archive(pages.limit(0))).count() == 0


def test_damaged_payload_is_an_error(spark):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string")
    whole = archive.write_archive(pages)
    bad = F.when(F.col("payload") == F.lit(b"two"), F.lit(b"tvo")).otherwise(F.col("payload"))
    spoilt = archive.Archive(spark, whole.payloads.withColumn("payload", bad), whole.headers)
    told = {r.record_id: r.verified for r in archive.restore(spoilt, strict=False).select("record_id", "verified").collect()}
    assert told == {1: True, 2: False}
    for column in ("payload_digest", "payload_bytes", "payload"):
        with pytest.raises(Exception, match="payload does not hash to [0-9a-f]{64}"):
            archive.restore(spoilt).select("record_id", column).collect()


def test_mix_of_rows_that_share_an_id(spark):
    """Rows of one id and weight differ in size only: the same are taken however the table is partitioned."""
    docs = spark.createDataFrame([(1, "w " * (1 + i % 5), s) for i in range(60) for s in "abc"], "doc_id long, text string, source string")
    taken = [sorted((r.source, r.size, r.taken) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7), docs.orderBy("text"))]
    assert taken[0] == taken[1] == taken[2] and any(t > 0 for _, _, t in taken[0])


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for at, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF_DIR)
        assert at == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in ("quality", "near_dedup"):
            assert 0 < docs.count() <= before
        if name == "line_dedup":
            assert docs.count() == before
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
        before = docs.count()
    assert docs.filter(~F.col("round_trip")).count() == 0
    assert corpus_pipeline.run(spark, SF_DIR).count() == before


BENCHMARK = "item_id long, text string, doc_id long, words string"


def items_of(spark, texts):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in texts], BENCHMARK)


def ascii_words(text, kept):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return "".join(c if c in kept or ord(c) > 127 else " " for c in low).split(" ")


def words_of(text, kept="abcdefghijklmnopqrstuvwxyz0123456789"):
    return [w for w in ascii_words(text, kept) if w]


def passages(seed, n=60):
    """Items, and documents with passages of them: whole, in parts, at the ends, overlapping, in other letters."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["\u00c9cole", "\u00e9cole", "Na\u00efve", "\u65e5\u672c"]
    fresh = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(fresh(rng.choice((1, 3, 5, 9, 10, 11, 25))))) for i in range(14)]
    items += [(20, None), (21, ""), (22, "-- !"), (None, " ".join(fresh(12))), (3, " ".join(fresh(14))), (23, items[5][1])]
    docs = []
    for i in range(n):
        words = fresh(rng.choice((0, 4, 9, 40)))
        for _ in range(rng.randrange(3)):
            passage = (rng.choice(items)[1] or "").split()
            low = rng.randrange(max(1, len(passage) - 8))
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[low : low + rng.choice((9, 10, 14, 30))]
        text = rng.choice((" ", "\n", ", ")).join(words)
        docs.append((i, text.upper() if i % 7 == 0 and text.isascii() else text))
    return items, docs + [*ODD, (2, "w1 w2 w3"), (7, docs[7][1])]


def hit_by_hand(items, docs, window=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[s : s + window])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hits, found = words_of(t), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if (x := tuple(w[s : s + size])) in windows:
                    hits |= set(range(s, s + size))
                    found |= windows[x]
        out.append((None if d == 99 else d, len(w), tuple(sorted(hits)), tuple(sorted(found))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "block"), [(1, 4_000_000), (2, 20)])
def test_contained_windows_equal_brute_force(spark, seed, block):
    items, docs = passages(seed)
    found = contain.decontaminate(docs_of(spark, docs), items_of(spark, items), block_rows=block)
    rows = [(r.doc_id, r.n_words, tuple(r.hits), tuple(r["items"])) for r in found.collect()]
    assert sorted(rows, key=repr) == hit_by_hand(items, docs) and any(r[2] for r in rows)


def test_contained_windows_of_empty_tables(spark):
    items, docs = items_of(spark, [(1, "one two")]), docs_of(spark, ODD)
    assert contain.decontaminate(docs.limit(0), items).count() == 0
    for none in (items.limit(0), items_of(spark, [(1, None), (2, "...")])):
        rows = contain.decontaminate(docs, none).collect()
        assert len(rows) == len(ODD) and not any(r.hits or r["items"] for r in rows)


def repaired_by_hand(rows):
    """Cheapest edits by trying all, least audit first: rows are ``(role, text)`` in order."""
    seen, facts, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        again, blank, cut = (role, text) in seen, not bare, bool(bare) and bare[-1] not in ".!?"
        seen.add((role, text))
        for k, fault in enumerate((blank, again and not blank, cut and not again)):
            counts[k] += fault
        facts.append((blank or again, 3 if cut else 0))
    order = {"": "", "s": "s", "u": "u", "a": "a"}
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}
    done = {}
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done[at, state] = True
        if at == len(rows) and order[state] in ("", "a"):
            return counts, cost, audit, "\n".join(out)
        for c in steps[state].replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", at, c, (*out, {"u": "user:", "a": "assistant:"}[c])))
        if at < len(rows):
            (role, text), (must_go, cut) = rows[at], facts[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if not must_go:
                if role[:1] and role[:1] in steps[state]:
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, role[:1], (*out, f"{role}:{text}")))
                for c in steps[state].replace("s", ""):
                    heapq.heappush(heap, (cost + 3 + cut, audit + "R", at + 1, c, (*out, {"u": "user:", "a": "assistant:"}[c] + text)))


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(25), None]:
        n = rng.choice((0, 1, 2, 5, 9, 60 if conv == 7 else 3))
        for k in range(n):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "umpire", "tool", ""))
            text = rng.choice(("Fine.", "Cut", "", " \t", "So? \n", f"Own {k}!", "caf\u00e9."))
            rows.append((conv, rng.choice((k, k + 1, None)), role, text, "x", 1))
    return rows + [(50, None, None, None, "x", 1), (51, 3, "user", None, "x", 1), (52, 1, "user", "word " * 50_000 + ".", "x", 1)]


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {}), (3, {"LONG_ROWS": 2, "PIECE_CHARS": 10, "UNROLLED": 3})])
def test_repairs_equal_brute_force(spark, monkeypatch, seed, limits):
    """Also with conversations that are cut into segments and pieces."""
    for name, value in limits.items():
        monkeypatch.setattr(dialogue, name, value)
    rows = talks(seed)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, cost int")
    repaired = dialogue.repair(frame)
    assert limits == {} or repaired.conversations.filter("repaired is null").count() > 3
    found = {r.conv_id: r for r in repaired.digests().collect()}
    assert set(found) == {r[0] for r in rows}
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        body = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        by_conv[conv].append((turn is not None, turn or 0, body, role, text, turn))
    for conv, own in by_conv.items():
        own.sort(key=lambda r: r[:3])
        pairs = [(r[3], r[4]) for r in own]
        counts, cost, audit, text = repaired_by_hand(pairs)
        turns = {r[5] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        r = found[conv]
        assert [r.blank, r.duplicate, r.truncated] == counts and (r.gaps, r.illegal) == (gaps, illegal)
        assert (r.cost, r.audit) == (cost, audit), (conv, pairs)
        assert r.sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_runs_by_powers():
    """A million equal rows: the cost is that of single steps, and the edits come in time that grows with the rows."""
    for sym in range(1, 9):
        slow = dialogue.AT_END
        for _ in range(1000):
            slow = dialogue.advance(sym, 1, slow)
        assert dialogue.advance(sym, 1000, dialogue.AT_END) == slow
    cost, edits = dialogue.solve([(3, 200_001), (5, 1)])
    audit = "".join(names for _, names in edits)
    assert cost == sum({"D": 4, "I": 3, "R": 3, "K": 0}[c] for c in audit) and len(audit.replace("I", "")) == 200_002


def test_repair_of_no_rows(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair(frame).digests().count() == 0
    whole = spark.createDataFrame([(1, 19, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    codes = {t: zlib.crc32(f"1:{t}".encode()) % 20 for t in range(100)}
    for code, rows in ((0, []), (1, [("user", "")]), (2, [("user", "Hi")]), (3, [("user", "Hi.")] * 2), (4, [("user", "Hi.")])):
        turn = next(t for t, c in codes.items() if c == code)
        damaged = dialogue.damage(whole.withColumn("turn", F.lit(turn).cast("long")).withColumn("role", F.lit("user")))
        assert [(r.role, r.text) for r in damaged.collect()] == rows


def ranked_by_hand(items, docs, top=20):
    terms = {k: words_of(t) for k, (_, t) in enumerate(docs)}
    counts = {k: collections.Counter(w) for k, w in terms.items()}
    texts, total = sum(map(bool, terms.values())), sum(map(len, terms.values()))
    df = collections.Counter(t for c in counts.values() for t in c)
    out = []
    for i, text in items:
        scored = []
        for k, c in counts.items():
            m = 75 + 25 * len(terms[k]) * texts // total
            score = sum(
                math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words_of(text) if c[t]
            )
            if score > 0:
                d = docs[k][0]
                scored.append((-score, d == 99, d))
        out += [(i, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "limits"), [(4, {}), (5, {"PIECE_BYTES": 16, "CELLS": 8})])
def test_ranks_equal_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked, name, value)
    items, docs = passages(seed)
    rows = [tuple(r) for r in ranked.search(docs_of(spark, docs), items_of(spark, items), block_bytes=300 if limits else 1 << 20).collect()]
    assert sorted(rows, key=repr) == ranked_by_hand(items, docs)
    few = ranked.search(docs_of(spark, docs), items_of(spark, items), top=2).collect()
    assert max(r["rank"] for r in few) == 2


def test_ranks_of_empty_tables(spark):
    docs, items = docs_of(spark, ODD), items_of(spark, [(1, "one two word"), (2, None)])
    assert {r.item_id for r in ranked.search(docs, items).collect()} == {1}
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs_of(spark, [(1, None), (2, "...")]), items)):
        assert ranked.search(a, b).count() == 0


def test_nbest_of_long_runs_ends():
    vocab = pieces.load()
    for c in "a=-":
        listed = pieces.nbest(vocab, pieces.SPACE + c * 30_000, 3)
        assert len({ids for _, ids in listed}) == 3 and listed[0][0] >= listed[1][0] >= listed[2][0]


def test_all_segmentations_come_back(spark):
    vocab = pieces.load()
    texts = [(i, t) for i, t in [(1, "unbelievable things happen"), (2, "a"), (3, ""), (4, None), (5, "caf\u00e9 \U0001f600 x\n y")]]
    for r in pieces.encode(docs_of(spark, texts), vocab).collect():
        text = dict(texts)[r.doc_id] or ""
        every = pieces.segmentations(r.ids, r.others)
        assert len(every) == len(r.scores) and len({tuple(x) for x in every}) == len(every)
        for ids, score in zip(every, r.scores, strict=True):
            assert pieces.decode_ids(vocab, ids) == text
            if all(math.isfinite(vocab.scores[i]) for i in ids):
                assert sum(vocab.scores[i] for i in ids) == pytest.approx(score)


def test_rows_that_share_an_id_keep_their_own_links(spark):
    words = [f"w{i}" for i in range(200)]
    one, two = " ".join(words[:60]), " ".join(words[100:160])
    texts = [(7, one), (7, two), (3, two + " more"), (8, one + " more"), (9, "alone here")]
    rows = minhash.near_duplicates(docs_of(spark, texts), k=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (7, 3), (7, 7), (8, 7), (9, 9)]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, [*texts, (9, "alone here"), (9, "not alone")]), SF_DIR)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, two + " more"), (7, one), (9, "alone here"), (9, "not alone")]


def test_bins_of_very_large_sets():
    hashes = np.arange(300_000, dtype=np.uint64) << np.uint64(30)
    counted = np.frombuffer(minhash.Signer(3).bins(hashes), np.uint32)
    assert counted.sum() == 300_000 and counted.max() > 65_535

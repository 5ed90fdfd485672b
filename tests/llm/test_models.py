"""Language ID and toxicity, and the pipeline of stages."""

import zlib

import numpy as np
import pytest

from pagemill.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def brute_phrases(text: bytes, sample: bytes) -> int:
    """Longest matches from left to right, over the whole text."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


def test_phrases_are_longest_matches():
    rng = np.random.default_rng(4)
    samples = {k: bytes(rng.choice(list(b"abcd "), 400).tolist()) for k in ("x", "y")}
    texts = [bytes(rng.choice(list(b"abcde "), n).tolist()) for n in (1, 5, 300, 5000)]
    model = language.Model(samples)
    want = [[brute_phrases(t, samples[k]) for k in ("x", "y")] for t in texts]
    for size in (1, 3, 50, language.PIECE):
        assert model.phrases(texts, size).tolist() == want


def test_phrases_go_over_pieces():
    """Parses that never meet: every phrase is as long as the sample."""
    samples = {"x": b"a" * 100, "y": b"ab" * 9}
    texts = [b"a" * 7001, b"ab" * 3000 + b"c", b"b" + b"a" * 333]
    want = [[brute_phrases(t, samples[k]) for k in ("x", "y")] for t in texts]
    for size in (7, 64, language.PIECE):
        assert language.Model(samples).phrases(texts, size).tolist() == want


def test_prediction_is_the_brute_one():
    rng = np.random.default_rng(5)
    alphabets = {"de": "abcdüß ", "en": "abcdef ", "fr": "abcdéè "}
    draw = lambda k, n: "".join(rng.choice(list(alphabets[k]), n))
    samples = {k: language.normal(draw(k, 900)) for k in alphabets}
    model = language.Model(samples)
    texts = [draw(k, n) for k in alphabets for n in (12, 90, 6000)]
    langs, scores = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        bits = {k: brute_phrases(language.normal(text), s) * np.log2(len(s)) for k, s in samples.items()}
        assert lang == min(bits, key=bits.get)
        assert abs(score - 1 / sum(np.exp((min(bits.values()) - b) / 16) for b in bits.values())) < 1e-9


def test_training_takes_whole_texts_of_bounded_rows(spark):
    rows = [(i, f"{'x' * i} " + "word " * 3000 + "last", "en") for i in range(50)] + [(7, "same text", "fr")] * 40 + [(8, "gleich", "de"), (9, None, "de"), (10, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    original = language.Model
    try:
        language.Model = lambda samples: seen.update(samples)
        language.fit(docs, 5)
    finally:
        language.Model = original
    assert set(seen) == {"en", "fr", "de"} and seen["fr"] == b" same text "
    assert seen["en"].count(b"last") == 5 and seen["en"].count(b"word") == 15_000


def test_identify_edges(nasty, empty):
    got = language.identify(nasty).collect()
    assert len(got) == nasty.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2 if r.doc_id is not None else False)
        assert (r.lang_pred == "und") == (r.doc_id in (65, 66, 67)) and 0 <= r.score <= 1
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(nasty.withColumn("lang", nasty.lang.substr(9, 1))).collect()} <= {"und", ""}
    kept = language.keep_identified(nasty)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 3


def test_unlabelled_is_unknown(nasty):
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in language.identify(nasty.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def test_toxicity_of_held_out_documents(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        own, bad = list(rng.choice(words, 60)), i % 4 == 0
        if bad:
            own[7] = rng.choice(["zzznasty", "zzvile"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad), 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.assess(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(held) > 80
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held)


def test_toxicity_edges(spark, nasty, empty):
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    got = toxicity.assess(nasty, marks).collect()
    assert len(got) == nasty.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    blank = {r.score for r in got if r.doc_id in (65, 66, 67)}
    assert len(blank) == 1
    assert toxicity.assess(empty, marks).count() == 0
    assert {r.predicted for r in toxicity.assess(nasty, marks.limit(0)).collect()} == {0}


def test_scores_of_one_gram_in_two_texts_do_not_mix():
    weights = np.zeros(1 << toxicity.BUCKETS, np.float32)
    weights[toxicity.grams("abcd")] = 1
    got = toxicity.Model(weights, np.ones(1 << toxicity.BUCKETS), 0.0).scores(["abcd", None, "abcd abcd", "abcd"])
    assert got[0] == got[3] > got[1] and got[2] > 0.5


def brute_toxicity(rows, asked):
    """The same regression on dense vectors, by plain gradient steps on its primal."""
    sets = [{h for n in (4, 5) for h in gram_set(t, n)} for t, _ in rows]
    names = sorted(set().union(*sets))
    y = np.array([k for _, k in rows])
    n1, n0 = y.sum(), (1 - y).sum()
    r = np.array([np.log((1 + sum(g in s and k == 1 for s, k in zip(sets, y, strict=True))) / (n1 + 2)) - np.log((1 + sum(g in s and k == 0 for s, k in zip(sets, y, strict=True))) / (n0 + 2)) for g in names])
    vector = lambda s: (lambda v: v / max(np.sqrt(v @ v), 1e-9))(r * np.array([g in s for g in names]))
    x = np.array([vector(s) for s in sets])
    w, b = np.zeros(len(names)), 0.0
    for _ in range(60_000):
        e = toxicity.COST * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 0.003 * (w + x.T @ e), b - 0.003 * (b + e.sum())
    return [float(vector({h for n in (4, 5) for h in gram_set(t, n)}) @ w + b) for t in asked]


def gram_set(text, n):
    data = f" {' '.join(text.lower().split())} ".encode()
    return {data[i : i + n] for i in range(len(data) - n + 1)}


def test_regression_is_the_brute_one(monkeypatch):
    monkeypatch.setattr(toxicity, "PASSES", 400)
    rows = [("you vile fool", 1), ("what a vile thing", 1), ("a fool and a thing", 1), ("what a fine thing", 0), ("a fine day to you", 0), ("the day is long", 0), ("long day and night", 0)]
    asked = ["vile day", "fine night", "", "fool"]
    bags, labels = [toxicity.bag(t) for t, _ in rows], np.array([k for _, k in rows])
    ratio = toxicity.ratios(bags, labels)
    got = toxicity.margins([toxicity.bag(t) for t in asked], ratio, *toxicity.descend(bags, labels, ratio, passes=400))
    assert np.allclose(got, brute_toxicity(rows, asked), atol=1e-3)
    model = toxicity.train(bags, labels)
    own = toxicity.margins(bags, ratio, *toxicity.descend(bags, labels, ratio))
    order = np.argsort(own)
    assert (np.diff(model.scores([rows[i][0] for i in order])) >= -1e-6).all()


def test_repeated_and_conflicting_labels(spark):
    rows = [(i, "vile stuff" if i % 2 else "fine stuff") for i in range(40)] * 2 + [(1, "x " * 200_000)]
    marks = [(i, i % 2) for i in range(40)] + [(3, 0), (3, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.assess(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id != 1)


def test_toxicity_of_supplied_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.assess(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.toxic for r in got) > 0.78 and hit / sum(r.predicted for r in got) > 0.9
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.96


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
    got = pipeline.run(spark, SF).collect()
    ordered = sorted(got, key=lambda r: r.start)
    assert ordered[0].start == 0 and all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(ordered, ordered[1:]))


def staged(spark, folder, rows, items):
    from tests.llm.conftest import SCHEMA

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_is_the_brute_one(spark, tmp_path):
    """Every stage again, one row at a time, on rows that have an id."""
    import duckdb
    import public_tokenizers

    from pagemill.llm import mixing, tokens
    from tests.llm.conftest import rows
    from tests.llm.test_search import brute_components, brute_hits

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = [r for r in rows() if r[0] is not None]
    items = [(1, docs[9][1]), (2, "not there at all"), (None, docs[20][1])]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in pipeline.run(spark, staged(spark, tmp_path, docs, items)).collect())
    left = [r for r in docs if any(c.isalpha() for c in r[1] or "")]
    least = {int(c) for _, _, c in brute_components([(r[0], r[1]) for r in left])}
    left = list({r[0]: r for r in left if r[0] in least}.values())
    hit = {int(h[0]) for h in brute_hits([(r[0], r[1]) for r in left], items) if h[5]}
    left = [r for r in left if r[0] not in hit]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in left])
    copies = {d: taken // size for d, size, _, _, taken in con.execute(mixing.ORACLE).fetchall()}
    want, at = [], 0
    tok = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for r in sorted(left):
        ids = tok.encode(r[1], add_special_tokens=False).ids + [2]
        for _ in range(copies[r[0]]):
            want.append((at, r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert hit and got == want and len(want) > 20


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import os

    from pagemill.llm.common import shared_dir
    from tests.llm.conftest import rows

    pipeline = pytest.importorskip("corpus_pipeline")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = pipeline.run(spark, staged(spark, tmp_path / "a", rows(), [(None, None)])).collect()
    assert any(r.doc_id is None for r in got) and not {65, 66, 67} & {r.doc_id for r in got}
    # What no later stage needs is gone.
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"stage-3", "stage-4", "wavelet", "wavelet-manifest"}
    assert pipeline.run(spark, staged(spark, tmp_path / "b", [], [])).count() == 0

"""Learned operators: plain models, held-out accuracy, grammar cases; the pipeline as a whole."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import lm_score, quality, toxicity


def test_lm_against_the_plain_automaton(spark):
    texts = ["the cat sat on the mat", "The cat sat", None, "", "a dog\tsat\non the mat", "unknown words only", "the the the"] * 3
    rows = list(enumerate(texts))
    for order in (1, 2, 3):
        got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), order=order).collect()}
        model = lm_score.BackoffAutomaton([t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], order)
        for i, t in rows:
            words = model.words(t or "")
            assert got[i].n_tokens == len(words) and got[i].train_tokens == model.total
            assert got[i].n_known == sum((w,) in model.counts for w in words)
            assert got[i].base_score == pytest.approx(sum(np.log10(model.weight((), w)) for w in words))
            assert got[i].score == pytest.approx(model.score(t or ""))
            assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 1)


def test_lm_over_sections_and_segments(spark, monkeypatch):
    """Many sections and buckets, one block a text, texts longer than a segment, text ids, digests that collide in 64 bits."""
    monkeypatch.setattr(lm_score, "SECTION_BYTES", 1 << 10)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 1 << 8)
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 64)
    r = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    rows = [(f"t{k}", " ".join(r.choices(words, k=r.choice([0, 1, 3, 64, 65, 200])))) for k in range(60)]
    got = {x.doc_id: x for x in lm_score.score(spark.createDataFrame(rows, "doc_id string, text string").repartition(5)).collect()}
    model = lm_score.BackoffAutomaton([t for i, t in rows if zlib.crc32(i.encode()) % 5 != 1], lm_score.ORDER)
    for i, t in rows:
        assert got[i].score == pytest.approx(model.score(t)) and got[i].n_tokens == len(model.words(t))
    g, c = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    distinct, first, number = lm_score._distinct(g, c)
    assert distinct.tolist() == [5, 5, 7] and g[first].tolist() == [5, 5, 7] and number.tolist() == [0, 1, 2, 0]
    n = np.array([0, 3, 255, 254, 10**12])
    assert lm_score._unpack(lm_score._pack(n)).tolist() == n.tolist()


def test_lm_weights_sum_to_one():
    model = lm_score.BackoffAutomaton(["a b a", "b c"], 2)
    vocabulary = {k[0] for k in model.counts if len(k) == 1}
    for state in ((None,), ("a",), ("b",), ("zz",)):
        assert sum(model.weight(state, w) for w in vocabulary | {"some unknown word"}) == pytest.approx(1)


def test_grammar():
    s = toxicity.Scorer(["idiot", "vequ"])
    plain, negated, reported, aimed, none = (s.text(t)[0] for t in ("a big idiot here", "not an idiot", "he said idiot", "you idiot", "good day"))
    assert none == 0 < negated < plain < aimed and reported < aimed
    assert s.text("une vequaire")[0] > 0 and s.text("you kill")[2] > s.text("i will kill")[2] > s.text("i will not kill")[2] > 0
    t = toxicity.grammar()
    assert t.weigh([toxicity.INSULT])[0] == 1.0 and t.write([toxicity.THREAT, toxicity.TARGET]) == [toxicity.THREAT, toxicity.LANDED_THREAT]


def test_composed_table_does_what_its_parts_do_in_turn():
    r = random.Random(1)
    parts = toxicity.transducers()
    whole = toxicity.grammar()
    for _ in range(400):
        symbols = [r.randrange(toxicity.SYMBOLS) for _ in range(r.randint(0, 14))]
        now, a, b = symbols, 0.0, 0.0
        for t in parts:
            x, y = t.weigh(now)
            now, a, b = t.write(now), a + x, b + y
        assert whole.weigh(symbols) == pytest.approx((a, b)) and whole.write(symbols) == now


def test_without_labels_clauses_still_tell(spark, empty):
    texts = ["You are an idiot.", "You are not an idiot.", "He said you are an idiot.", "I will kill you.", "I will not kill you.", "We kill time.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.score(df, labels).orderBy("doc_id").collect()] == [1, 0, 0, 1, 0, 0, 0]


def test_weights_are_learned(spark):
    """Where labels say that reported insults are toxic and plain threats aren't, the weights follow."""
    rows = [(f"{a} said the {b} idiot left {k}", 1) for k, (a, b) in enumerate([("ann", "old"), ("bob", "new"), ("joe", "odd")] * 40)]
    rows += [(f"{a} said the {b} boat left {k}", 0) for k, (a, b) in enumerate([("ann", "old"), ("bob", "new"), ("joe", "odd")] * 40)]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(rows)], "doc_id bigint, text string, toxic int")
    m = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert m.symbols[toxicity.WEAK_INSULT] > 2 * toxicity.PRIOR[toxicity.WEAK_INSULT]
    got = toxicity.score(df.drop("toxic"), df.select("doc_id", "toxic")).join(df.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(r.predicted == r.toxic for r in got)


def test_compiled_rules_do_what_they_say(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, 3))
    rules = [(((0, "<=", 0.5), (1, ">", 0.2)), 1.5), (((2, ">", 0.7),), -2.0), ((), 0.25)]
    want = 1 / (1 + np.exp(-(0.3 + sum(w * quality._holds(x, r) for r, w in rules))))
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = [r[0] for r in df.select(quality.compile_rules(0.3, rules, ["a", "b", "c"])).collect()]
    assert np.allclose(got, want)


def test_pipeline_of_odd_rows(spark, odd, tmp_path, sf):
    import corpus_pipeline as p

    odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(20, "two words", "en", "s", 9), (21, "one", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")).write.parquet(f"{tmp_path}/documents.parquet")
    for name, rows in (("labels", [(20, 1, 1), (21, None, None), (None, 1, 0)]), ("benchmark", [])):
        kind = "doc_id bigint, quality int, toxic int" if name == "labels" else "item_id bigint, text string"
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = p.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} >= {1, 5, 9, 20, None}


def accuracy(df, labels, label, cut):
    got = df.join(labels.select("doc_id", label), "doc_id").where("held_out").select(label, "score").collect()
    return np.mean([(r.score >= cut) == bool(r[label]) for r in got])


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    assert accuracy(toxicity.score(docs, labels), labels, "toxic", 0.5) > 0.97
    assert accuracy(quality.score(docs, labels), labels, "quality", 0.3) > 0.95


def test_rules():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)).astype(float)
    intercept, rules = quality.fit_rules(x, y)
    z = intercept + sum(w * quality._holds(x, r) for r, w in rules)
    assert ((z > 0) == (y == 1)).mean() > 0.97
    assert quality.fit_rules(x, np.ones(2000)) == (0.0, [])


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (7, 0, 1)], "doc_id bigint, quality int, toxic int")
    for f in (toxicity.score, quality.score):
        got = f(odd, labels)
        assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1 or held_out is null").count() == 0
        assert f(empty, labels.limit(0)).count() == 0
    assert lm_score.score(odd).count() == odd.count()
    assert lm_score.score(empty).count() == 0
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = p.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() < docs.count()
    got = p.run(spark, sf)
    assert set(got.columns) >= {"doc_id", "n_tokens"} and 0 < got.count() <= docs.count()
    assert got.where(~F.col("decoded_equal")).count() == 0

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from codequery.llm import op4_quality_classifier as op4
from codequery.llm import op7_language_id as op7

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = op4.op4_quality_classifier(spark, SF)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").select("quality", "score", "predicted").collect()
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.95
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_quality_edges(spark):
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(None, None)], "doc_id long, quality int")
    told = op4.describe(docs.select("*", F.lit(1).alias("x"), F.lit(2).alias("data")))
    got = op4.score(told, op4.learn(told, labels)).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 1)] * 4
    none = op4.describe(docs.limit(0))
    assert op4.score(none, op4.learn(none, labels)).collect() == []
    twice = op4.describe(docs.union(docs))
    assert op4.score(twice, op4.learn(twice, spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "doc_id long, quality int"))).count() == 8


def test_quality_sums_are_the_risk_and_its_derivatives():
    rng = np.random.default_rng(3)
    edges = np.sort(rng.random((op4.FEATURES, op4.BINS - 1)), 1)
    at = op4._hot(edges, rng.random((40, op4.FEATURES)))
    w = rng.normal(0, 0.3, op4.SIZE)
    own = op4.sums(w, at)
    risk = lambda w, sign: sum(np.log1p(np.exp(-sign * (sum(w[k] for k in row) + w[-1]))) for row in at)
    assert np.isclose(own["loss_up"][0], risk(w, 1)) and np.isclose(own["loss_down"][0], risk(w, -1))
    for k in (0, 17, 100, op4.SIZE - 1):
        step = np.zeros(op4.SIZE)
        step[k] = 1e-5
        for name, sign in (("up", 1), ("down", -1)):
            assert np.isclose(own[name][k], (risk(w + step, sign) - risk(w - step, sign)) / 2e-5, atol=1e-4)
        slope = (op4.sums(w + step, at)["down"] - op4.sums(w - step, at)["down"]) / 2e-5
        assert np.allclose(own["curve"].reshape(op4.SIZE, op4.SIZE)[k], slope, atol=1e-4)


def test_quality_steps_back_where_the_negative_risk_is_below_zero():
    down_p, down_u = np.ones(op4.SIZE), np.full(op4.SIZE, 0.25)
    zero = {"n": np.ones(1), "loss_up": np.ones(1), "up": np.zeros(op4.SIZE), "curve": np.eye(op4.SIZE).ravel()}
    calls = []

    def total(w):
        calls.append(w)
        return {**zero, "loss_down": np.array([9.0]), "down": down_p}, {**zero, "loss_down": np.array([1.0]), "down": down_u}

    w = op4.newton(total, 0.5, steps=1)
    assert np.allclose(w, 0.25 - 0.5 * 1.0)


def test_class_prior_from_scores_of_positives_and_a_mixture():
    rng = np.random.default_rng(5)
    good, bad = (lambda n: rng.beta(8, 2, n)), (lambda n: rng.beta(2, 8, n))
    for prior in (0.3, 0.7):
        n = 20_000
        u = np.concatenate([good(int(n * prior)), bad(int(n * (1 - prior)))])
        found = op4.prior_of(*(np.histogram(x, 1000, (0, 1))[0] for x in (good(5000), u)))
        assert abs(found - prior) < 0.06


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op7.op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97


def test_language_edges_and_bag(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "en"), (2, "12 %", "de"), (4, "½ ²", "de"), (5, "① 12", "en"), (3, "x", None)], "doc_id long, text string, lang string")
    model = op7.train([op7_bag(b"the and of the"), op7_bag("und der die".encode())] * 20, ["en", "de"] * 20)
    got = op7.predict(docs, model).collect()
    assert [r.lang_pred for r in got[:5]] == ["und"] * 5 and got[5].lang_pred in ("de", "en") and all(r.rejected for r in got[:5])
    assert {r.lang_pred for r in op7.predict(docs, op7.learn(docs.where("false"))).collect()} == {"und"}
    data = np.random.default_rng(0).integers(97, 123, (1 << 20) + 7, dtype=np.uint8).tobytes()
    assert op7.bag(data).sum() == 3 * len(data) - 6
    assert (op7.bag(b"ab" * 600_000) > 0).sum() <= 6


def op7_bag(data):
    b = op7.bag(data)
    at = np.flatnonzero(b)
    return at, b[at].astype(float)


def test_stages_keep_columns_and_good_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for stage in (op4.stage, op7.stage):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        good = labels.where(F.col("quality") == 1).join(docs, "doc_id").select("doc_id")
        assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()


def test_language_repeats_and_clashing_columns(spark):
    rows = [(i % 7, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "x", 0.5) for i in range(60)] + [(None, "the", "en", "y", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, data string, score double")
    got = op7.predict(docs, op7.learn(docs)).collect()
    assert len(got) == 61 and {r.lang_pred for r in got} <= {"en", "de"}
    many = docs.union(docs).union(docs)
    assert [r.lang_pred for r in op7.predict(docs, op7.learn(many)).collect()] == [r.lang_pred for r in got]  # repeats teach nothing


def test_language_learns_from_every_language_however_often_ids_repeat(spark):
    """Rows that share an id must not push the last languages out of the sample."""
    rows = [(1, "alpha beta gamma", "aa")] * 50 + [(i, "zeta omega psi", "zz") for i in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(op7.learn(docs, sample_docs=20).langs) >= {"zz"}


def test_language_is_learned_beside_the_driver(spark):
    """The sample's bags stay in a task; the driver's Python gets the model alone, the one that train() makes of the same texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tracemalloc.start()
    try:
        model = op7.learn(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.table.shape == (1 << op7.BITS, len(model.langs)) and peak < 4 * model.table.nbytes + (4 << 20)
    few = docs.where("lang is not null and text is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").limit(60)
    bags = sorted((r.lang, *(x.tobytes() for x in op7_bag(r.text.encode()))) for r in few.collect())
    order = sorted((lang, np.frombuffer(a, np.int64).astype("<u2").tobytes(), np.frombuffer(c).astype("<u4").tobytes()) for lang, a, c in bags)
    here = op7.train([(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(np.float64)) for _, a, c in order], [x for x, _, _ in order])
    there = op7.learn(few)
    assert there.langs == here.langs and np.allclose(there.table, here.table, atol=1e-4) and np.allclose(there.bias, here.bias, atol=1e-4)
    assert np.isclose(there.temperature, here.temperature) and np.isclose(there.threshold, here.threshold, atol=1e-4)


def test_quality_shift_puts_the_prior_above_half():
    scores = np.random.default_rng(8).beta(2, 3, 50_000)
    b = op4.shift(np.histogram(scores, 10_000, (0, 1))[0], 0.6)
    assert abs(np.mean(np.log(scores / (1 - scores)) + b >= 0) - 0.6) < 0.01

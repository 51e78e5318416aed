import numpy as np

from gradeloom.llm import knn_quality


def auc(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1
    good = truth.sum()
    return (order[truth].sum() - good * (good + 1) / 2) / (good * (~truth).sum())


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in knn_quality.predict(docs, labels).collect()]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    scores, good = np.array([r.score for r in held]), np.array([truth[r.doc_id] == 1 for r in held])
    assert len(held) > 500 and auc(scores, good) > 0.95
    assert np.mean(good == (scores >= 0.3)) > 0.95


def test_vote_equals_brute_force():
    rng = np.random.default_rng(1)
    similarity, labels = rng.normal(size=(40, 200)), (rng.random(200) < 0.8).astype(float)
    for row, got in zip(similarity, knn_quality.vote(similarity, labels, 7)):
        best = sorted(range(200), key=lambda k: -row[k])[:7]
        weights = [min(1, max(0, row[k])) ** knn_quality.SHARPNESS for k in best]
        assert np.isclose(got, sum(w * labels[k] for w, k in zip(weights, best)) / sum(weights))
    assert np.allclose(knn_quality.vote(np.full((2, 200), -1.0), labels), labels.mean())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "AB " * 40_000), (4, "plain words in here"), (4, "plain words in here"), (None, "x")]
    docs = spark.createDataFrame([(*r, "en", 0.1, 5) for r in rows], "doc_id long, text string, lang string, score double, label int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 9)] + [(4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = knn_quality.predict(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in knn_quality.predict(docs, labels.limit(0)).collect()} == {0.5}
    assert knn_quality.predict(docs.limit(0), labels).collect() == []

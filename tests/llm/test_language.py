import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import language


def brute(scores, transitions):
    """Marginals by summing over all labellings; the first word follows a uniform state."""
    n, k = scores.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = sum(np.exp(transitions[s, path[0]]) for s in range(k)) * np.exp(sum(scores[t, path[t]] for t in range(n)))
        p *= np.exp(sum(transitions[path[t], path[t + 1]] for t in range(n - 1)))
        for t in range(n):
            out[t, path[t]] += p
    return out / out.sum(axis=1, keepdims=True)


def brute_edges(scores, transitions):
    """Expected transitions between neighbours, by summing over all labellings."""
    n, k = scores.shape
    out, total = np.zeros((k, k)), 0
    for path in itertools.product(range(k), repeat=n):
        p = sum(np.exp(transitions[s, path[0]]) for s in range(k)) * np.exp(sum(scores[t, path[t]] for t in range(n)))
        p *= np.exp(sum(transitions[path[t], path[t + 1]] for t in range(n - 1)))
        total += p
        for t in range(n - 1):
            out[path[t], path[t + 1]] += p
    return out / total


def test_marginals_and_edges_equal_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 7, 2, 9, 4, 8])
    scores, transitions = rng.normal(0, 2, (lengths.sum(), 3)), rng.normal(0, 1, (3, 3))
    at = np.cumsum(lengths) - lengths
    want = np.concatenate([brute(scores[a : a + n], transitions) for a, n in zip(at, lengths)])
    edges = sum(brute_edges(scores[a : a + n], transitions) for a, n in zip(at, lengths))
    for size in (2, 3, 32):
        assert np.allclose(language.marginals(scores, lengths, transitions, size), want)
        assert np.allclose(language.edge_sums(*language.messages(scores, lengths, transitions, size), lengths, transitions), edges)


def test_long_text_stays_finite():
    rng = np.random.default_rng(2)
    lengths = np.array([30_000, 5])
    found = language.marginals(rng.normal(0, 30, (lengths.sum(), 4)), lengths, rng.normal(0, 2, (4, 4)))
    assert np.isfinite(found).all() and np.allclose(found.sum(axis=1), 1)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language.predict_documents(docs).collect() if r.held_out]
    assert len(got) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switching_and_odd_rows(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {lang: source.where(f"lang = '{lang}' AND doc_id > 50 AND n_chars > 800").orderBy("doc_id").first().text for lang in ("de", "es")}
    mixed = " ".join(text["de"].split()[:60] + text["es"].split()[:60])
    odd = [(1, None, "en"), (2, "", "en"), (3, "12 34 !", None), (4, mixed, None), (None, text["de"], "es"), (5, text["es"], "es"), (5, text["es"], "es"), (6, text["es"] * 60, None), (7, "É", None)]
    frame = spark.createDataFrame([(*r, "x", 0.5) for r in odd], "doc_id long, text string, lang string, lang_pred string, score double")
    got = sorted(language.identify(frame, source.select("doc_id", "text", "lang"), with_words=True).collect(), key=lambda r: r.doc_id or 0)
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3))
    assert by[None].lang_pred == "de" and by[5].lang_pred == "es" and by[6].lang_pred == "es"
    longest = sorted(by[4].runs, key=lambda r: r["first"] - r["last"])[:2]
    assert {r["lang"] for r in longest} == {"de", "es"} and all(45 <= r["last"] - r["first"] for r in longest)


def test_bytes_and_clashing_columns(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    german = source.where("lang = 'de' AND n_chars > 800").orderBy("doc_id").first().text
    frame = spark.createDataFrame([(1, german, 7, "a", "b"), (2, None, 8, "c", "d")], "doc_id long, text string, score int, lang_pred string, row string")
    broken = frame.withColumn("text", F.when(F.col("doc_id") == 1, F.concat(F.col("text").cast("binary"), F.lit(b" \xff\xfe caf\xe9"))))
    got = {r.row.doc_id: r for r in language.label(broken, source.select("doc_id", "text", "lang")).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("de", "und")
    assert (got[1].row.score, got[1].row.lang_pred, got[1].row.row) == (7, "a", "b") and bytes(got[1].row.text).endswith(b"caf\xe9")


def test_many_languages_fit_into_memory():
    """Ninety invented languages of seven whole documents each: words are told apart, memory stays far below a gigabyte."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = []
    for k in range(90):
        own = rng.dirichlet(np.full(26, 0.15))
        vocabulary = ["".join(rng.choice(letters, rng.integers(3, 9), p=own)) for _ in range(80)]
        texts += [(f"l{k:02}", " ".join(rng.choice(vocabulary, 150)) + ".") for _ in range(7)]
    tracemalloc.start()
    field = language.fit([t for at, t in enumerate(texts) if at % 7])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(field.labels) == 90 and peak < 700e6
    scorer = language._Scorer(field)
    right = 0
    for lang, text in texts[::7]:
        words = text.split()
        found = language.marginals(scorer(words)[0], np.array([len(words)]), field.transitions)
        right += field.labels[found.sum(axis=0).argmax()] == lang
    assert right >= 85


def test_too_many_languages_are_refused(spark):
    rows = spark.createDataFrame([(k, "a text", f"l{k}") for k in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 8 languages"):
        language.sample(rows, most_languages=8)


def test_whole_texts_are_learned_from(spark):
    rows = spark.createDataFrame([(1, "word " * 9000 + "end", "x")], "doc_id long, text string, lang string")
    assert language.sample(rows) == [("x", "word " * 9000 + "end")]


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "a text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.predict_documents(frame).collect()] == [(1, False, "und", 0.0)]
    assert language.predict_documents(frame.limit(0)).collect() == []


def test_every_language_is_learned_from(spark):
    rows = [(k, f"text {k} of its language", f"l{k % 90:02}") for k in range(360)]
    found = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for lang, _ in found} == {f"l{k:02}" for k in range(90)}

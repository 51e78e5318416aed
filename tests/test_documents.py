"""Indented results documents read by ranges, against a JSON parser."""

import json
import random

import pytest

from gradeloom.sources import readers

FIELDS = ["question_id", "question", "template", "response", "success", "error", "attempts", "input_tokens", "output_tokens"]
ODD = ['plain', 'a "quoted" \\ text', "line\n      {\n        \"no\": 1\n      },\n    ],\n    \"x\": [\nend", "é ☃ 𝄞", "", None, "}\n      }", "{" * 50]


def run(seed, groups, rows):
    rng = random.Random(seed)
    out = {}
    for p in range(3):
        out[f"p{p} \"q\" é"] = {
            f"s{s}\n\\": [
                {"question_id": k, "question": rng.choice(ODD), "strategy": "own", "template": "t", "provider": "own", "response": rng.choice(ODD),
                 "success": rng.random() < 0.5, "error": None, "attempts": k % 3, "input_tokens": 1, "output_tokens": 2, "extra": {"nested": [{"a": 1}, {}]}}
                for k in range(rng.choice(rows))
            ]
            for s in range(groups)
        }
    return out | {"none": {}}


def flat(documents):
    out = []
    for document in documents:
        for provider, strategies in document.items():
            for strategy, rows in strategies.items():
                out += [(provider, strategy, k, *[r.get(f) for f in FIELDS]) for k, r in enumerate(rows)] or [(provider, strategy, None, *[None] * len(FIELDS))]
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.select("provider", "strategy", "position", *FIELDS).collect()), key=repr)


@pytest.fixture()
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "300b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [2, 4])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_ranges_equal_the_parser(spark, tmp_path, small_ranges, indent, ascii_only):
    documents = [run(1, 3, [0, 1, 7]), run(2, 1, [40]), run(3, 5, [0]), {}, {"p": {}}]
    for k, d in enumerate(documents):
        (tmp_path / f"d{k}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=ascii_only))
    got = readers.read_indented_results(spark, str(tmp_path), indent)
    assert found(got) == flat(documents)


def test_many_tasks_read_one_file(spark, tmp_path, small_ranges):
    document = {"p": {"s": [{"question_id": k, "response": "x" * 300} for k in range(50)], "t": [{"response": "y" * 300} for _ in range(20)]}}
    (tmp_path / "d.json").write_text(json.dumps(document, indent=2))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = readers.read_indented_results(spark, str(tmp_path)).groupBy("strategy").agg({"question_id": "sum", "*": "count"}).collect()
    assert sorted(map(tuple, got)) == [("s", 50, sum(range(50))), ("t", 20, sum(range(20)))]  # without a number: the place in the list


def test_other_layouts_fall_back(spark, tmp_path):
    documents = [run(4, 2, [3]), run(5, 1, [2]), run(6, 2, [0, 2]), run(7, 2, [2])]
    (tmp_path / "compact.json").write_text(json.dumps(documents[0]))
    (tmp_path / "lines.json").write_text(json.dumps(documents[1]) + "\n" + json.dumps(documents[2]) + "\n")
    (tmp_path / "wide.json").write_text(json.dumps(documents[3], indent=7))
    assert found(readers.read_indented_results(spark, str(tmp_path))) == flat(documents)


def test_batch_documents(spark, tmp_path, small_ranges):
    rows = [{"question_id": k, "response": f"r{k}", "choices": ["a", "b"], "answer": k % 4, "success": True} for k in range(30)]
    (tmp_path / "b.json").write_text(json.dumps({"first": rows, "empty": [], "last": rows[:3]}, indent=2))
    got = readers.read_indented_batch_results(spark, str(tmp_path)).collect()
    assert sorted((r.strategy, r.question_id, r.answer, r.provider) for r in got if r.question_id is not None) == sorted(
        (s, r["question_id"], r["answer"], "openai") for s, n in (("first", 30), ("last", 3)) for r in rows[:n]
    )
    assert [(r.strategy, r.position) for r in got if r.question_id is None] == [("empty", None)]


def test_written_documents(spark, tmp_path, make_responses):
    from gradeloom.sinks import writers

    rows = make_responses(*[{"provider": p, "strategy": s, "question_id": k, "response": ODD[k % len(ODD)], "success": k % 2 == 0} for p in ("b", "a") for s in ("y", "x\"") for k in range(9)])
    writers.write_indented_results(rows, str(tmp_path / "out"), files=2)
    texts = [f.read_text() for f in (tmp_path / "out").rglob("*.txt")]
    values = [json.loads(t) for t in texts]
    assert all(json.dumps(v, indent=2, ensure_ascii=False) + "\n" == t for v, t in zip(values, texts))
    want = sorted((r.provider, r.strategy, r.question_id, r.response, r.success) for r in rows.collect())
    got = readers.read_indented_results(spark, str(tmp_path / "out"))
    assert sorted(((r.provider, r.strategy, r.question_id, r.response, r.success) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_long_runs_get_more_documents(spark, tmp_path, make_responses, monkeypatch):
    from gradeloom.sinks import writers

    monkeypatch.setattr(writers, "DOCUMENT_CHARS", 1000)
    rows = make_responses(*[{"question_id": k, "response": "x" * 100} for k in range(80)])
    writers.write_indented_results(rows, str(tmp_path / "out"), files=2, compression="gzip")
    assert 6 <= len(list((tmp_path / "out").rglob("*.txt.gz"))) <= 9
    got = readers.read_indented_results(spark, str(tmp_path / "out"))
    assert sorted((r.question_id, r.response) for r in got.collect()) == [(k, "x" * 100) for k in range(80)]


def test_later_settings_do_not_move_rows(spark, tmp_path, small_ranges):
    """The rows are read again when they are used; files are then cut as they were when the groups were found."""
    documents = [run(8, 3, [0, 1, 7]), run(9, 1, [40]), run(10, 2, [5])]
    for k, d in enumerate(documents):
        (tmp_path / f"d{k}.json").write_text(json.dumps(d, indent=2))
    got = readers.read_indented_results(spark, str(tmp_path))
    for size, cost in (("200b", "1b"), ("128m", "4m")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        assert found(got) == flat(documents)


def test_documents_of_many_groups(spark, tmp_path, make_responses, monkeypatch):
    """More groups than are broadcast, some without a name: each document is still whole and in order."""
    from gradeloom.sinks import writers

    monkeypatch.setattr(writers, "FEW_GROUPS", 3)
    rows = make_responses(*[{"provider": p, "strategy": s, "question_id": k, "response": ODD[k % len(ODD)]} for k in range(9) for p in ("b", "a") for s in ("y", "x")])
    writers.write_indented_results(rows.coalesce(3), str(tmp_path / "out"), files=2)
    texts = [f.read_text() for f in (tmp_path / "out").rglob("*.txt")]
    assert 2 <= len(texts) <= 4 and all(json.dumps(json.loads(t), indent=2, ensure_ascii=False) + "\n" == t for t in texts)
    got = readers.read_indented_results(spark, str(tmp_path / "out"))
    assert sorted((r.provider, r.strategy, r.question_id, r.response) for r in got.na.fill("").collect()) == sorted((r.provider, r.strategy, r.question_id, r.response or "") for r in rows.collect())

"""Reading documents in their original single-file shapes, and round trips."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import quality, routing
from gradeloom.plans import report
from gradeloom.sinks import writers
from gradeloom.sources import readers

ROW = {"question_id": 0, "question": "Q", "strategy": "baseline", "template": "verbose", "provider": "openai", "response": "Answer: A", "success": True, "error": None, "attempts": 1, "input_tokens": 3, "output_tokens": 4}
FAILED = {k: v for k, v in ROW.items() if k not in ("input_tokens", "output_tokens")} | {"question_id": 1, "response": None, "success": False, "error": "timeout"}


def test_pretty_printed_results_document(spark, tmp_path):
    doc = {"openai": {"baseline": [ROW, FAILED], "roberta": []}, "gemini": {"baseline": [ROW]}}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=2))
    rows = readers.read_results(spark, str(tmp_path), whole_files=True)
    got = {(r.provider, r.strategy): (r.total, r.failed) for r in quality.success_rates(rows).collect()}
    assert got == {("openai", "baseline"): (2, 1), ("openai", "roberta"): (0, 0), ("gemini", "baseline"): (1, 0)}
    assert rows.where("NOT success").first().output_tokens is None


def test_batch_document_has_no_provider_level(spark, tmp_path):
    row = {k: v for k, v in ROW.items() if k not in ("question_id", "provider", "strategy", "error", "attempts")}
    row |= {"choices": ["x", "y"], "answer": 1, "category": "c", "total_tokens": 7}
    (tmp_path / "b.json").write_text(json.dumps({"baseline": [row, row], "roberta": [row]}))
    rows = readers.read_batch_results(spark, str(tmp_path))
    assert sorted((r.provider, r.strategy, r.question_id) for r in rows.collect()) == [
        ("openai", "baseline", 0), ("openai", "baseline", 1), ("openai", "roberta", 0),
    ]
    assert {(tuple(r.choices), r.answer, r.category, r.total_tokens) for r in rows.collect()} == {(("x", "y"), 1, "c", 7)}


def test_question_document_by_position(spark, tmp_path):
    q = {"question": "Q", "subject": "s", "category": "c", "expected_template": "minimal", "choices": ["x"], "answer": 2, "original_split": "dev"}
    doc = {"metadata": {"split": "test", "embedding_dim": 2}, "questions": [q, q | {"question": "R"}], "embeddings": [[1.0, 2.0], [3.0, 4.0]]}
    (tmp_path / "q.json").write_text(json.dumps(doc, indent=2))
    rows = readers.read_question_documents(spark, str(tmp_path), multiline=True).orderBy("question_id").collect()
    assert [(r.question_id, r.question, r.split, r.embedding) for r in rows] == [(0, "Q", "test", [1.0, 2.0]), (1, "R", "test", [3.0, 4.0])]
    bare = {k: v for k, v in doc.items() if k != "embeddings"}
    (tmp_path / "q.json").write_text(json.dumps(bare))
    assert readers.read_question_documents(spark, str(tmp_path), multiline=True).count() == 2


def test_run_choice(spark, tmp_path):
    for n in (9, 10, 100):
        (tmp_path / f"run_n{n}_results.json").write_text(json.dumps({"openai": {"baseline": [ROW] * n}}))
    (tmp_path / "notes.txt").write_text("x")
    assert readers.choose_run(spark, str(tmp_path)).endswith("_n100_results.json")
    assert readers.read_results(spark, readers.choose_run(spark, str(tmp_path), 9)).count() == 9
    with pytest.raises(FileNotFoundError, match="found: 9, 10, 100$"):
        readers.choose_run(spark, str(tmp_path), 11)


def test_predictions_array_file_and_missing_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"question": "Q", "baseline": "verbose"}, {"question": "R", "ground_truth": "minimal", "baseline": "verbose"}], indent=1))
    predictions = readers.read_predictions(spark, str(tmp_path / "p.json"), multiline=True)
    assert sorted((r.question_id, r.question, r.ground_truth) for r in predictions.collect()) == [(0, "Q", None), (1, "R", "minimal")]
    doc = {"openai": {"roberta": [ROW | {"template": "minimal", "question_id": k} for k in (1, 0)]}, "gemini": {"roberta": [ROW | {"question_id": 9}]}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    rows = readers.read_results(spark, str(tmp_path / "r.json"), whole_files=True)
    assert sorted((r.provider, r.question_id, r.position) for r in rows.collect()) == [("gemini", 9, 0), ("openai", 0, 1), ("openai", 1, 0)]
    accuracy = routing.router_accuracy(predictions, rows)
    assert sorted((r.provider, r.matches, r.misses) for r in accuracy.collect()) == [("gemini", 0, 2), ("openai", 1, 1)]
    agreement = routing.router_agreement(predictions, rows)
    assert {(r.provider, r.compared, r.agreed) for r in agreement.collect()} == {("gemini", 0, 0), ("openai", 0, 0)}
    assert readers.read_predictions(spark, str(tmp_path / "absent.json")).count() == 0


def test_cache_files_one_per_key(spark, tmp_path):
    for q in (1, 2):
        for p in ("openai", "gemini"):
            entry = {"question_id": q, "question": "Q", "provider": p, "timestamp": "2024-01-01T00:00:00", "response": f"{p}{q}", "success": True, "error": None, "attempts": 1}
            (tmp_path / f"q_{q:04d}_{p}.json").write_text(json.dumps(entry, indent=2))
    assert readers.read_cache(spark, str(tmp_path), "gemini", 2, multiline=True).first().response == "gemini2"
    assert readers.read_cache(spark, str(tmp_path), "claude", 2, multiline=True).count() == 0


def test_provider_document_and_tracker(spark, tmp_path):
    doc = {"provider": "openai", "total_questions": 1, "successful": 1, "failed": 0, "responses": [{"question_id": 4, "response": "x", "success": True, "attempts": 1}]}
    (tmp_path / "openai_responses.json").write_text(json.dumps(doc, indent=2))
    assert readers.read_provider_documents(spark, str(tmp_path / "openai_responses.json")).first().question_id == 4
    tracker = {"created_at": "t", "num_questions": 5, "provider": "openai", "status": "submitted", "strategies": {"baseline": {"batch_id": "b1", "status": "completed"}, "roberta": {"batch_id": "b2", "status": "failed"}}}
    (tmp_path / "tracker.json").write_text(json.dumps(tracker))
    assert sorted((r.strategy, r.status) for r in readers.read_tracker(spark, str(tmp_path / "tracker.json")).collect()) == [("baseline", "completed"), ("roberta", "failed")]
    saved = {"timestamp": "t", "total_questions": 2, "questions": ["a", "b"]}
    (tmp_path / "questions.json").write_text(json.dumps(saved, indent=2))
    rows = readers.read_saved_questions(spark, str(tmp_path / "questions.json"), multiline=True).collect()
    assert sorted((r.question_id, r.question) for r in rows) == [(0, "a"), (1, "b")]


def test_results_rewrite_only_their_partitions(spark, tmp_path, make_responses):
    path = str(tmp_path / "runs")
    writers.write_results(make_responses({}, {"strategy": "roberta"}), path, 2)
    writers.write_results(make_responses({"strategy": "roberta", "response": "new"}, {"strategy": "roberta", "response": "new"}), path, 2)
    got = spark.read.parquet(path).groupBy("strategy").agg(F.collect_set("response").alias("s"), F.count("*").alias("n"))
    assert {r.strategy: (r.s, r.n) for r in got.collect()} == {"baseline": (["Answer: A"], 1), "roberta": (["new"], 2)}


def test_whole_analysis(spark, tmp_path, make_responses):
    rows = make_responses(*[{"question_id": q, "strategy": s, "provider": p, "output_tokens": 10 + 40 * q} for q in range(4) for s in ("baseline", "simple_neural", "roberta") for p in ("openai", "gemini")])
    predictions = spark.createDataFrame([(q, "verbose", "verbose", "verbose", "verbose") for q in range(4)], "question_id bigint, ground_truth string, baseline string, simple_neural string, roberta string")
    key = spark.createDataFrame([(q, 0) for q in range(4)], "question_id bigint, answer int")
    tables = report.analyse(rows, predictions, key)
    report.save_analysis(tables, str(tmp_path / "out"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out" / "summary_report.txt")).collect())
    assert "questions 4, providers 2, strategies 3, calls 24" in text and "openai / roberta: 100.00% of predictions match (4)" in text
    nested = json.loads(spark.read.text(str(tmp_path / "out" / "validation_report.json")).first().value)
    assert nested["gemini"]["baseline"]["low_token_responses"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "success_rates.csv")).count() == 6
    assert tables["verdict"].first().verdict == "EXCELLENT"

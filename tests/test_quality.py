"""Structural cases of the quality, routing and usage measures, and published arithmetic."""

import math

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.numbers import percent, ratio, whole_average
from gradeloom.operators import facts, merge, quality, requests, routing, usage


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.first().asDict()


def test_ratios(spark):
    df = spark.range(1)
    value = lambda c: df.select(c).first()[0]
    assert value(percent(F.lit(164611), F.lit(498425))) == 33.03
    assert value(percent(F.lit(905), F.lit(1000))) == 90.5
    assert value(percent(F.lit(285), F.lit(1000))) == 28.5
    assert value(percent(F.lit(1), F.lit(0))) == 0
    assert value(ratio(F.lit(None).cast("int"), F.lit(2))) == 0
    assert [value(whole_average(F.lit(a), F.lit(b))) for a, b in ((5, 2), (7, 2), (498425, 1000), (1, 0))] == [2, 4, 498, 0]


def test_empty_strategy_is_reported(spark, make_responses):
    rows = make_responses({}, {"success": False, "response": None, "output_tokens": None})
    ghost = make_responses({"strategy": "roberta"}).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("provider", "strategy") else F.col(f.name) for f in rows.schema]
    )
    both = rows.unionByName(ghost)
    assert one(quality.success_rates(both), strategy="roberta") == {
        "provider": "openai", "strategy": "roberta", "total": 0, "succeeded": 0, "failed": 0, "success_rate_pct": 0.0,
    }
    stats = one(quality.validation_stats(both), strategy="roberta")
    assert stats["total_responses"] == 0 and stats["failed_responses"] == 0 and stats["median_tokens"] is None
    assert one(quality.success_rates(both), strategy="baseline")["success_rate_pct"] == 50.0


@pytest.mark.parametrize("tokens", [[1, 2, 3, 4], [5], [9, 1, 5], [20, 20, 300, 99, 100, 19, None]])
def test_upper_median_and_buckets(make_responses, tokens):
    stats = quality.validation_stats(make_responses(*[{"output_tokens": t} for t in tokens])).first()
    real = sorted(t or 0 for t in tokens)
    assert stats.median_tokens == real[len(real) // 2]
    assert (stats.min_tokens, stats.max_tokens) == (real[0], real[-1])
    assert stats.avg_tokens == pytest.approx(round(sum(real) / len(real), 1))
    assert stats.tokens_lt_20 + stats.tokens_20_100 + stats.tokens_100_300 + stats.tokens_ge_300 == len(real)
    assert stats.low_token_responses == sum(t < 20 for t in real)


def test_funnel_and_answer_key(spark, make_responses):
    rows = make_responses(
        {"response": "Answer: A"}, {"response": "Answer: B"}, {"response": "  "}, {"response": "api error"},
        {"response": "nothing to find in here"}, {"response": "Answer: C", "question_id": 99}, {"response": "Answer: D", "question_id": 5},
    )
    key = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, None)], "question_id bigint, answer int")
    graded = facts.grade(facts.classify(rows), key, ["provider", "strategy"])
    f = quality.funnel(graded).first().asDict()
    # question 99 is past the key: neither correct nor incorrect; a missing key answer counts as incorrect
    assert f == {
        "provider": "openai", "strategy": "baseline", "total": 7, "empty": 1, "errors": 1, "valid": 5, "extractable": 4,
        "non_extractable": 1, "correct": 1, "incorrect": 2,
    }
    overall = quality.funnel_with_overall(graded)
    assert overall.count() == 2 and one(overall, provider="ALL")["total"] == 7
    without_key = quality.funnel(facts.grade(facts.classify(rows), None, ["provider", "strategy"])).first()
    assert (without_key.extractable, without_key.correct, without_key.incorrect) == (4, 0, 0)


@pytest.mark.parametrize("counts, verdict", [((1000, 995, 960), "EXCELLENT"), ((1000, 989, 960), "GOOD"), ((1000, 960, 849), "ISSUES"), ((1000, 949, 949), "ISSUES")])
def test_dataset_verdict(spark, counts, verdict):
    df = spark.createDataFrame([counts], "total long, valid long, extractable long")
    assert quality.dataset_verdict(df).first().verdict == verdict


@pytest.mark.parametrize("counts, verdict, ok", [((100, 85, 60), "SUCCESS", True), ((100, 84, 10), "PARTIAL", False), ((100, 49, 40), "FAIL", True), ((0, 0, 0), "FAIL", False)])
def test_run_verdict(spark, counts, verdict, ok):
    got = quality.run_verdict(spark.createDataFrame([counts], "total long, extractable long, correct long")).first()
    assert (got.verdict, got.accuracy_ok) == (verdict, ok)


def test_pairs_need_both_strategies(make_responses):
    rows = make_responses({}, {"strategy": "roberta", "success": False}, {"provider": "gemini"})
    got = routing.compare_strategies(rows).collect()
    assert [(r.provider, r.comparison, r.first_success_pct, r.second_success_pct, r.improvement_pct) for r in got] == [
        ("openai", "baseline_vs_roberta", 100.0, 0.0, -100.0)
    ]


def test_agreement_counts_two_missing_templates_as_equal(spark, make_responses):
    rows = make_responses(
        {"question_id": 1, "strategy": "simple_neural", "template": None}, {"question_id": 1, "strategy": "roberta", "template": None},
        {"question_id": 2, "strategy": "simple_neural", "template": "verbose"}, {"question_id": 2, "strategy": "roberta", "template": None},
        {"question_id": 3, "strategy": "roberta"},
    )
    predictions = spark.createDataFrame([(i, "verbose", "verbose") for i in (1, 2, 3, 4)], "question_id bigint, ground_truth string, baseline string")
    got = routing.router_agreement(predictions, rows).first()
    assert (got.compared, got.agreed, got.agreement_pct) == (2, 1, 25.0)


def test_savings_published_numbers(spark):
    totals = spark.createDataFrame(
        [("openai", "baseline", 498425), ("openai", "simple_neural", 333814), ("openai", "roberta", 338640)], "provider string, strategy string, total_tokens long"
    )
    got = {r.strategy: (r.savings, r.savings_pct) for r in usage.with_savings(totals).collect()}
    assert got == {"baseline": (0, 0.0), "simple_neural": (164611, 33.03), "roberta": (159785, 32.06)}
    costs = {r.strategy: r.cost for r in usage.output_cost(totals, usage.output_prices(spark)).collect()}
    assert costs["baseline"] == 4.98425


def test_correlation_of_published_counts(spark):
    rows = [("simple_neural", 74, 285, 518, 104, 19), ("roberta", 71, 276, 532, 104, 17)]
    counts = spark.createDataFrame(rows, "strategy string, minimal long, standard long, verbose long, executive long, technical long")
    assert round(routing.routing_correlation(counts, "simple_neural", "roberta").first()[0], 4) == 0.9995


def test_weighted_scores_against_hand_count(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    got = routing.weighted_scores(spark.createDataFrame(pairs, "ground_truth string, predicted string")).first()
    p = {"a": 1 / 2, "b": 2 / 3, "c": 0}
    r = {"a": 1 / 2, "b": 1, "c": 0}
    f = {k: 2 * p[k] * r[k] / (p[k] + r[k]) if p[k] + r[k] else 0 for k in p}
    support = {"a": 2, "b": 2, "c": 1}
    mean = lambda m: sum(m[k] * support[k] for k in m) / 5
    assert (got.accuracy, got.precision, got.recall, got.f1) == pytest.approx((0.6, mean(p), mean(r), mean(f)), abs=1e-5)


def test_cv_summary_uses_population_deviation(spark):
    df = spark.createDataFrame([(1, 0.9, 0.8, 0.7, 10.0), (2, 0.95, 0.9, 0.8, 20.0)], "fold int, train_accuracy double, val_accuracy double, val_f1 double, train_time double")
    got = routing.cv_summary(df).first()
    assert (got.cv_mean_accuracy, got.cv_std_accuracy, got.cv_mean_f1, got.avg_gap, got.total_time) == pytest.approx((0.85, 0.05, 0.75, 0.075, 30.0))
    gaps = sorted(r.gap for r in routing.fold_gaps(df).collect())
    assert gaps == pytest.approx([0.05, 0.1])


def test_improvement(spark):
    df = spark.createDataFrame([("x", 0.953), ("y", 0.8)], "m string, accuracy double")
    got = {r.m: r for r in routing.improvement_over_reference(df).collect()}
    assert math.isclose(got["x"].savings_per_million, 651.0) and got["y"].savings_per_million == 0


def test_hot_question_merges_to_its_first_row(make_responses):
    """Most rows are copies of one question; the earliest position wins."""
    copies = [{"question_id": 7, "position": p, "success": p != 3, "response": f"r{p}"} for p in range(3, 400)]
    rows = make_responses(*copies, {"question_id": 8, "provider": "gemini", "position": 1}, {"question_id": 7, "provider": "gemini", "position": 2})
    firsts = merge.first_response(rows, "position")
    assert {(r.provider, r.question_id): r.response for r in firsts.collect()}[("openai", 7)] == "r3"
    spined = merge.on_spine(merge.question_outcomes(rows, ["openai", "gemini"], "position"), 10)
    assert merge.merge_statistics(spined).first() == (10, 8, 1)
    assert sorted(tuple(r) for r in merge.failure_rows(spined).collect())[-1] == (9, "all_failed")
    merged = {r.question_id: r for r in merge.merge_questions(firsts, ["openai", "gemini"]).collect()}
    assert set(merged[7].responses) == {"openai", "gemini"} and merged[8].question == "q"


def test_cache_upsert_prefers_newer_then_incoming(spark):
    schema = "question_id bigint, provider string, timestamp timestamp, response string"
    t = lambda s: f"2024-01-01 00:0{s}:00"
    old = spark.createDataFrame([(1, "a", t(1), "old"), (2, "a", t(5), "old"), (3, "a", t(1), "old")], schema.replace("timestamp timestamp", "timestamp string"))
    new = spark.createDataFrame([(1, "a", t(1), "new"), (2, "a", t(4), "new"), (4, "a", t(1), "new")], schema.replace("timestamp timestamp", "timestamp string"))
    got = {r.question_id: r.response for r in merge.upsert_cache(old, new).collect()}
    assert got == {1: "new", 2: "old", 3: "old", 4: "new"}


def test_missing_success_counts_as_failed(make_responses):
    rows = make_responses({"success": None}, {}, {"success": False}, {"question_id": 0, "success": False})
    assert [r[0] for r in merge.failed_questions(rows).collect()] == [0, 2]


def test_request_modes(spark):
    calls = spark.createDataFrame(
        [(3, "openai", "simple_neural", "Q", ["x"], "PROMPT", 50)],
        "question_id bigint, provider string, strategy string, question string, choices array<string>, system_prompt string, max_tokens int",
    )
    batch = requests.request_lines(calls).first().value
    assert batch == (
        '{"custom_id":"q3_simple_neural","method":"POST","url":"/v1/chat/completions","body":{"model":"gpt-4o-mini",'
        '"messages":[{"role":"system","content":"PROMPT"},{"role":"user","content":"Q\\n\\nA) x"}],"max_tokens":50,"temperature":0.0}}'
    )
    assert '"content":"PROMPT\\n\\nQuestion: Q\\n\\nA) x"' in requests.request_lines(calls, mode="live").first().value


def test_unknown_template_gets_fallbacks(spark):
    plan = spark.createDataFrame([(1, "gemini", "odd"), (2, "openai", "minimal"), (3, "claude", None)], "question_id bigint, provider string, template string")
    got = {r.question_id: r for r in requests.with_caps(requests.with_prompts(plan, requests.prompt_table(spark)), requests.cap_table(spark)).collect()}
    from gradeloom import fixed_values as fv

    assert got[1].system_prompt == fv.PROMPTS["gemini"]["standard"] and got[1].max_tokens == 1000
    assert got[2].system_prompt == fv.PROMPTS["default"]["minimal"] and got[2].max_tokens == 50
    assert got[3].system_prompt == fv.PROMPTS["default"]["standard"]


def test_batch_states(spark):
    jobs = spark.createDataFrame([("a", "completed", 5, 5), ("b", "expired", 1, 4), ("c", "finalizing", 0, 0), ("d", "new", 1, 3)], "s string, status string, completed long, total long")
    got = {r.s: (r.percent_done, r.state) for r in requests.batch_progress(jobs).collect()}
    assert got == {"a": (100.0, "done"), "b": (25.0, "stopped"), "c": (0.0, "pending"), "d": (33.3, "unknown")}
    assert requests.all_complete(jobs).first()[0] is False

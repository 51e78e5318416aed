"""Joins and aggregates over the response log."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom import fixed_values as fv
from gradeloom.catalog import data, oracle as o
from gradeloom.catalog.expressions import _FUNNEL_SUMS, _LINES_CTE, _TOTALS, _batch_lines, _caps_cte
from gradeloom.catalog.registry import query
from gradeloom.operators import facts, merge, prepare, quality, requests, routers, routing, usage
from gradeloom.plans import consolidate, history
from gradeloom.plans.report import response_facts
from gradeloom.session import pin, scratch_path
from gradeloom.sources import readers

_SUCCESS = """SELECT provider, strategy, count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed"""


def _graded(spark, sf):
    return response_facts(data.responses(spark, sf), data.answer_key(spark, sf))


# ---- joins -------------------------------------------------------------------------------


@query("jon_01_questions_embeddings", o.over("SELECT question_id, category, len(embedding) AS dims, unnest(range(0, len(embedding))) AS dimension, CAST(unnest(embedding) AS DOUBLE) AS value FROM questions JOIN embeddings ON vec_id = question_id"))
def _(spark, sf):
    joined = prepare.with_embeddings(data.questions(spark, sf), data.question_embeddings(spark, sf))
    return joined.select("question_id", "category", F.size("embedding").alias("dims"), F.posexplode("embedding").alias("dimension", "value")).select(
        "question_id", "category", "dims", F.col("dimension").cast("long").alias("dimension"), F.col("value").cast("double").alias("value")
    )


@query("jon_02_predictions_responses", o.over("""SELECT r.question_id, r.provider, r.strategy, coalesce(p.ground_truth, p.baseline, 'standard') AS truth, r.template,
 coalesce(p.ground_truth, p.baseline, 'standard') IS NOT DISTINCT FROM r.template AS matches FROM responses r JOIN predictions p USING (question_id) WHERE strategy <> 'baseline'"""))
def _(spark, sf):
    used = data.responses(spark, sf).where("strategy <> 'baseline'").select("question_id", "provider", "strategy", "template")
    joined = used.join(routing.routing_truth(data.predictions(spark, sf)), "question_id")
    return joined.withColumn("matches", F.col("truth").eqNullSafe(F.col("template")))


@query("jon_03_answer_key", o.over_classified("SELECT question_id, provider, strategy, stage, extracted AS answer, has_key, key_letter, correct FROM graded"))
def _(spark, sf):
    return facts.grade(facts.classify(data.responses(spark, sf)), data.answer_key(spark, sf), ["provider", "strategy"])


@query("jon_04_batch_lines_questions", o.over(_LINES_CTE + """SELECT l.question_id, l.strategy, q.category, q.answer, array_to_string(q.choices, '|') AS choices, l.response, l.input_tokens, l.output_tokens, l.total_tokens
 FROM lines l JOIN questions q USING (question_id) WHERE status_code = 200"""))
def _(spark, sf):
    rows = readers.batch_responses(readers.parse_batch_lines(_batch_lines(spark, sf)), data.questions(spark, sf))
    return rows.select(
        "question_id", "strategy", "category", "answer", F.array_join("choices", "|").alias("choices"), "response",
        "input_tokens", "output_tokens", "total_tokens",
    )


_PAIRS_SQL = f""", rates AS ({_SUCCESS} FROM responses GROUP BY ALL),
pairs(a, b) AS (VALUES ('baseline', 'simple_neural'), ('baseline', 'roberta'), ('simple_neural', 'roberta'))
SELECT x.provider, a || '_vs_' || b AS comparison, {o.pct('x.succeeded', 'x.total')} AS first_success_pct, {o.pct('y.succeeded', 'x.total')} AS second_success_pct,
 {o.pct('(y.succeeded - x.succeeded)', 'x.total')} AS improvement_pct FROM pairs JOIN rates x ON x.strategy = a JOIN rates y ON y.strategy = b AND y.provider = x.provider"""


@query("jon_05_strategy_pairs", o.over(_PAIRS_SQL.replace("FROM responses", "FROM request_log")))
def _(spark, sf):
    log = data.request_log(spark, sf).withColumnRenamed("event_id", "question_id")
    return routing.compare_strategies(log)


@query("jon_06_router_pairs", o.over("""SELECT a.provider, coalesce(a.template, 'none') AS first_template, coalesce(b.template, 'none') AS second_template, count(*) AS n
 FROM responses a JOIN responses b ON a.provider = b.provider AND a.question_id = b.question_id WHERE a.strategy = 'simple_neural' AND b.strategy = 'roberta' GROUP BY ALL"""))
def _(spark, sf):
    pairs = routing._side_by_side(data.responses(spark, sf), "simple_neural", "roberta")
    return pairs.groupBy(
        "provider", F.coalesce("first_template", F.lit("none")).alias("first_template"), F.coalesce("second_template", F.lit("none")).alias("second_template")
    ).agg(F.count(F.lit(1)).alias("n"))


_FIRSTS = """, firsts AS (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY provider, question_id ORDER BY position) = 1),
n AS (SELECT max(doc_id) + 1 AS n FROM documents),
spine AS (SELECT unnest(range(0, (SELECT n FROM n))) AS question_id),
merged AS (SELECT s.question_id, count(f.question_id) AS answered, count(*) FILTER (f.success) AS succeeded, count(*) FILTER (NOT f.success) AS failed,
  min_by(f.question, CASE f.provider WHEN 'openai' THEN 0 WHEN 'gemini' THEN 1 ELSE 2 END) AS question
 FROM spine s LEFT JOIN firsts f USING (question_id) GROUP BY s.question_id) """


def _outcomes(spark, sf):
    total = data.table(spark, sf, "documents").agg(F.max("doc_id") + 1).first()[0]
    return merge.on_spine(merge.question_outcomes(data.responses(spark, sf), fv.PROVIDERS, "position"), total)


@query("jon_07_question_spine", o.over(_FIRSTS + "SELECT question_id, succeeded, failed, succeeded = 0 AS all_failed, succeeded > 0 AND failed > 0 AS partial_failure FROM merged"))
def _(spark, sf):
    return _outcomes(spark, sf).select("question_id", "succeeded", "failed", "all_failed", "partial_failure")


@query("jon_08_compare_question", o.over("""SELECT question_id, CASE provider WHEN 'claude' THEN 1 WHEN 'openai' THEN 2 END AS provider_no, provider, question, response, success, error
 FROM responses WHERE strategy = 'baseline' AND provider IN ('claude', 'openai') AND question_id = (SELECT max(question_id) FROM questions)"""))
def _(spark, sf):
    wanted = data.questions(spark, sf).agg(F.max("question_id")).first()[0]
    cache = data.responses(spark, sf).where("strategy = 'baseline'")
    return merge.compare_question(cache, wanted, ["claude", "openai"])


@query("jon_09_work_plan", o.over("""SELECT question_id, provider, strategy FROM questions CROSS JOIN (VALUES ('openai'), ('gemini'), ('claude')) p(provider)
 CROSS JOIN (VALUES ('baseline'), ('simple_neural'), ('roberta')) s(strategy)"""))
def _(spark, sf):
    return requests.work_plan(data.questions(spark, sf).select("question_id"))


@query("jon_10_pending_work", o.over("""SELECT question_id, provider, strategy FROM questions CROSS JOIN (VALUES ('openai'), ('gemini'), ('claude')) p(provider)
 CROSS JOIN (VALUES ('baseline'), ('simple_neural'), ('roberta')) s(strategy)
 WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.question_id = questions.question_id AND r.provider = p.provider AND r.strategy = s.strategy AND r.success)"""))
def _(spark, sf):
    plan = requests.work_plan(data.questions(spark, sf).select("question_id"))
    return merge.pending_work(plan, data.responses(spark, sf).where("success"), ["question_id", "provider", "strategy"])


@query("jon_11_cost_quality", o.over_classified(_TOTALS + f""", acc AS (SELECT provider, strategy, {o.pct("count(*) FILTER (stage = 'valid' AND correct)", "count(*) FILTER (stage = 'valid' AND extracted IS NOT NULL)")} AS accuracy_pct FROM graded GROUP BY ALL)
SELECT t.provider, t.strategy, round(total_tokens / CAST(1000000 AS DOUBLE) * price, 6) AS cost, accuracy_pct FROM totals t JOIN prices USING (provider) JOIN acc ON acc.provider = t.provider AND acc.strategy = t.strategy"""))
def _(spark, sf):
    rows = data.responses(spark, sf).withColumn("estimate", usage.estimated_tokens())
    graded = facts.grade(facts.classify(rows), data.answer_key(spark, sf), [*quality.GROUP, "estimate"])
    counts = pin(quality.funnel(graded, quality.GROUP, F.coalesce(F.sum("estimate"), F.lit(0)).alias("total_tokens")))
    accuracy = quality.funnel_rates(counts).withColumnRenamed("correct_pct", "accuracy_pct")
    return usage.cost_quality(counts, usage.output_prices(spark), accuracy)


@query("jon_12_planned_calls", o.over(_caps_cte(fv.LIVE_MAX_TOKENS) + """SELECT q.question_id, p.provider, s.strategy,
 CASE strategy WHEN 'baseline' THEN 'verbose' WHEN 'simple_neural' THEN coalesce(r.simple_neural, 'standard') ELSE coalesce(r.roberta, 'standard') END AS template,
 CASE WHEN provider = 'gemini' THEN 'gemini' ELSE 'default' END AS prompt_family, coalesce(max_tokens, 1000) AS max_tokens
FROM questions q JOIN predictions r ON r.question_id = q.question_id CROSS JOIN (VALUES ('openai'), ('gemini'), ('claude')) p(provider)
 CROSS JOIN (VALUES ('baseline'), ('simple_neural'), ('roberta')) s(strategy)
LEFT JOIN caps ON caps.template = CASE strategy WHEN 'baseline' THEN 'verbose' WHEN 'simple_neural' THEN coalesce(r.simple_neural, 'standard') ELSE coalesce(r.roberta, 'standard') END"""))
def _(spark, sf):
    calls = requests.planned_calls(data.questions(spark, sf).select("question_id"), data.predictions(spark, sf))
    return calls.select("question_id", "provider", "strategy", "template", "prompt_family", "max_tokens")


# ---- aggregates --------------------------------------------------------------------------


@query("agg_01_success_rates", o.over(f"{_SUCCESS}, {o.pct('count(*) FILTER (success)', 'count(*)')} AS success_rate_pct FROM responses GROUP BY ALL"))
def _(spark, sf):
    return quality.success_rates(data.responses(spark, sf))


_MIX = f"""SELECT provider, strategy, coalesce(template, 'unknown') AS template, count(*) AS n, {o.pct('count(*)', 'sum(count(*)) OVER (PARTITION BY provider, strategy)')} AS percentage FROM responses GROUP BY provider, strategy, coalesce(template, 'unknown')"""


@query("agg_02_template_distribution", o.over(_MIX))
def _(spark, sf):
    return quality.template_distribution(data.responses(spark, sf))


_TRUTH = "coalesce(p.ground_truth, p.baseline, 'standard')"
_ACCURACY = f""", acc AS (SELECT provider, strategy, count(*) FILTER (r.template = {_TRUTH}) AS matches FROM responses r JOIN predictions p USING (question_id) WHERE strategy <> 'baseline' GROUP BY ALL),
accuracy AS (SELECT provider, strategy, matches, (SELECT count(*) FROM predictions) - matches AS misses, {o.pct('matches', '(SELECT count(*) FROM predictions)')} AS accuracy_pct FROM acc) """


@query("agg_03_router_accuracy", o.over(_ACCURACY + "SELECT * FROM accuracy"))
def _(spark, sf):
    return routing.router_accuracy(data.predictions(spark, sf), data.responses(spark, sf))


_AGREEMENT = f""", pair AS (SELECT a.provider, a.template IS NOT DISTINCT FROM b.template AS same FROM responses a JOIN responses b ON a.provider = b.provider AND a.question_id = b.question_id
  WHERE a.strategy = 'simple_neural' AND b.strategy = 'roberta'),
agreement AS (SELECT provider, count(*) AS compared, count(*) FILTER (same) AS agreed, {o.pct('count(*) FILTER (same)', '(SELECT count(*) FROM predictions)')} AS agreement_pct FROM pair GROUP BY provider) """


@query("agg_04_router_agreement", o.over(_AGREEMENT + "SELECT * FROM agreement"))
def _(spark, sf):
    return routing.router_agreement(data.predictions(spark, sf), data.responses(spark, sf))


_SAVINGS = """, savings AS (SELECT t.provider, t.strategy, t.total_tokens, t.counted, CAST(coalesce(round_even(t.total_tokens / CAST(nullif(t.counted, 0) AS DOUBLE), 0), 0) AS BIGINT) AS avg_tokens,
 b.total_tokens - t.total_tokens AS savings, coalesce(round((CAST(b.total_tokens AS DOUBLE) - t.total_tokens) / nullif(b.total_tokens, 0) * 100, 2), 0) AS savings_pct
 FROM totals t JOIN totals b ON b.provider = t.provider AND b.strategy = 'baseline') """


@query("agg_05_token_savings", o.over(_TOTALS + _SAVINGS + "SELECT * FROM savings"))
def _(spark, sf):
    return usage.token_savings(data.responses(spark, sf))


@query("agg_05_token_savings_reported", o.over(_TOTALS.replace(o.token_estimate("response"), "coalesce(output_tokens, 0)") + _SAVINGS + "SELECT * FROM savings"))
def _(spark, sf):
    return usage.token_savings(data.responses(spark, sf), F.col("output_tokens"))


@query("agg_06_router_comparison", o.over(_PAIRS_SQL))
def _(spark, sf):
    return routing.compare_strategies(data.responses(spark, sf))


_STATS = """, ok AS (SELECT provider, strategy, coalesce(output_tokens, 0) AS t, row_number() OVER (PARTITION BY provider, strategy ORDER BY coalesce(output_tokens, 0)) - 1 AS i,
  count(*) OVER (PARTITION BY provider, strategy) AS c FROM responses WHERE success),
stats AS (SELECT provider, strategy, r.total_responses, r.failed_responses, count(*) FILTER (t < 20) AS low_token_responses, min(t) AS min_tokens, max(t) AS max_tokens, round(avg(t), 1) AS avg_tokens,
  max(t) FILTER (i = c // 2) AS median_tokens, count(*) FILTER (t < 20) AS tokens_lt_20, count(*) FILTER (t >= 20 AND t < 100) AS tokens_20_100,
  count(*) FILTER (t >= 100 AND t < 300) AS tokens_100_300, count(*) FILTER (t >= 300) AS tokens_ge_300
 FROM ok JOIN (SELECT provider, strategy, count(*) AS total_responses, count(*) FILTER (NOT success) AS failed_responses FROM responses GROUP BY ALL) r USING (provider, strategy) GROUP BY ALL) """


@query("agg_07_validation_stats", o.over(_STATS + "SELECT * FROM stats"))
def _(spark, sf):
    return quality.validation_stats(data.responses(spark, sf))


_SUSPICIOUS = f""", suspicious AS (SELECT provider, strategy, question_id AS question_idx, substring(question, 1, 100) AS question, coalesce(output_tokens, 0) AS output_tokens,
 substring(response, 1, 200) AS response_preview, response AS full_response, {o.likely_error('response')} AS likely_error, coalesce(template, 'unknown') AS template_used
 FROM responses WHERE success AND coalesce(output_tokens, 0) < 20) """


@query("agg_08_suspicious_responses", o.over(_SUSPICIOUS + "SELECT * FROM suspicious"))
def _(spark, sf):
    return quality.suspicious_responses(data.responses(spark, sf))


@query("agg_09_likely_errors", o.over(_SUSPICIOUS + "SELECT provider, strategy, count(*) AS low_token_responses, count(*) FILTER (likely_error) AS likely_errors FROM suspicious GROUP BY ALL"))
def _(spark, sf):
    return quality.likely_error_counts(data.responses(spark, sf))


_HEADER = """SELECT count(DISTINCT question_id) AS questions, count(DISTINCT provider) AS providers, count(DISTINCT strategy) AS strategies,
 count(DISTINCT question_id) * count(DISTINCT provider) * count(DISTINCT strategy) AS total_calls FROM responses"""


@query("agg_10_run_header", o.over(_HEADER))
def _(spark, sf):
    return quality.run_header(data.responses(spark, sf))


_RATES = ", ".join(f"{o.pct(c, 'total')} AS {c}_pct" for c in ("empty", "errors", "valid", "extractable", "non_extractable")) + ", " + ", ".join(
    f"{o.pct(c, 'extractable')} AS {c}_pct" for c in ("correct", "incorrect")
)


@query("agg_11_validation_funnel", o.over_classified(f", f AS (SELECT provider, strategy, {_FUNNEL_SUMS} FROM graded GROUP BY ALL) SELECT *, {_RATES} FROM f"))
def _(spark, sf):
    return quality.funnel_rates(quality.funnel(_graded(spark, sf)))


_ACROSS = o.over_classified(f""", f AS (SELECT provider, strategy, {_FUNNEL_SUMS} FROM graded GROUP BY ALL), t AS (
 SELECT provider, strategy, count(*) FILTER (NOT success) AS failed_responses, count(*) FILTER (success AND coalesce(output_tokens, 0) < 20) AS low_token_responses,
  min(coalesce(output_tokens, 0)) FILTER (success) AS min_tokens, max(coalesce(output_tokens, 0)) FILTER (success) AS max_tokens, round(avg(coalesce(output_tokens, 0)) FILTER (success), 1) AS avg_tokens
 FROM responses GROUP BY ALL) SELECT f.*, failed_responses, low_token_responses, min_tokens, max_tokens, avg_tokens, true AS median_near FROM f JOIN t USING (provider, strategy)""")


@query("agg_11_across_runs", _ACROSS)
def _(spark, sf):
    """Three runs' states added up; the median is compared with the tokens' true ranks within the sketch's error."""
    path = scratch_path(spark, "states")
    rows = data.responses(spark, sf)
    for run in range(3):
        part = rows.where(F.pmod(F.xxhash64("question_id"), F.lit(3)) == run)
        history.add_run(response_facts(part, data.answer_key(spark, sf), "success", "output_tokens"), path, f"r{run}")
    found = history.across_runs(spark, path)
    tokens = rows.where("success").select("provider", "strategy", F.coalesce("output_tokens", F.lit(0)).alias("tokens"))
    ranked = tokens.join(F.broadcast(found.select("provider", "strategy", "median_tokens")), ["provider", "strategy"]).groupBy("provider", "strategy").agg(
        F.avg((F.col("tokens") < F.col("median_tokens")).cast("double")).alias("below"), F.avg((F.col("tokens") <= F.col("median_tokens")).cast("double")).alias("upto")
    )
    near = (F.col("below") <= 0.5 + history.RANK_ERROR) & (F.col("upto") >= 0.5 - history.RANK_ERROR)
    columns = ["provider", "strategy", *quality._FUNNEL, "failed_responses", "low_token_responses", "min_tokens", "max_tokens", "avg_tokens"]
    return found.join(ranked, ["provider", "strategy"]).select(*columns, near.alias("median_near"))


@query("agg_12_funnel_overall", o.over_classified(f", f AS (SELECT coalesce(provider, 'ALL') AS provider, coalesce(strategy, 'ALL') AS strategy, {_FUNNEL_SUMS} FROM graded GROUP BY GROUPING SETS ((provider, strategy), ())) SELECT *, {_RATES} FROM f"))
def _(spark, sf):
    return quality.funnel_rates(quality.funnel_with_overall(_graded(spark, sf)))


@query("agg_13_raw_extraction", o.over_classified(f""", f AS (SELECT provider, strategy, count(*) AS total, count(extracted) AS extractable, count(*) FILTER (correct) AS correct FROM graded GROUP BY ALL)
SELECT *, {o.pct('extractable', 'total', 1)} AS extraction_pct, {o.pct('correct', 'extractable', 1)} AS accuracy_pct FROM f"""))
def _(spark, sf):
    return quality.raw_extraction(_graded(spark, sf))


_SCORED = f""", scored AS (SELECT question_id, expected_template AS ground_truth, {o._TEMPLATE_OF['simple_neural']} AS predicted FROM questions) """


@query("agg_14_classifier_accuracy", o.over(_SCORED + f"SELECT count(*) FILTER (ground_truth = predicted) AS correct, count(*) AS total, {o.pct('count(*) FILTER (ground_truth = predicted)', 'count(*)')} AS accuracy_pct FROM scored"))
def _(spark, sf):
    return routing.classifier_accuracy(data.scored_predictions(spark, sf))


@query("agg_15_accuracy_per_template", o.over(_SCORED + f"SELECT ground_truth, count(*) FILTER (ground_truth = predicted) AS correct, count(*) AS total, {o.pct('count(*) FILTER (ground_truth = predicted)', 'count(*)')} AS accuracy_pct FROM scored GROUP BY ground_truth"))
def _(spark, sf):
    return routing.classifier_accuracy(data.scored_predictions(spark, sf), ["ground_truth"])


@query("agg_16_confusion", o.over(_SCORED + "SELECT ground_truth, predicted, count(*) AS n FROM scored GROUP BY ALL"))
def _(spark, sf):
    return routing.confusion(data.scored_predictions(spark, sf))


@query("agg_16_confusion_table", o.over(_SCORED + "SELECT ground_truth, " + ", ".join(f"count(*) FILTER (predicted = '{t}') AS {t}" for t in fv.TEMPLATES) + " FROM scored GROUP BY ALL"))
def _(spark, sf):
    return routing.confusion_table(routing.confusion(data.scored_predictions(spark, sf)))


@query("agg_17_category_distribution", o.over(f"SELECT category, count(*) AS n, {o.pct('count(*)', 'sum(count(*)) OVER ()')} AS share_pct FROM questions GROUP BY category"))
def _(spark, sf):
    return prepare.distribution(data.questions(spark, sf), ["category"])


def _counts_sql(s):
    return f"SELECT '{s}' AS strategy, " + ", ".join(f"count(*) FILTER ({s} = '{t}') AS {t}" for t in fv.TEMPLATES) + f", count({s}) AS total FROM predictions"


_COUNTS = ", counts AS (" + " UNION ALL ".join(_counts_sql(s) for s in fv.STRATEGIES) + ") "


@query("agg_18_prediction_counts", o.over(_COUNTS + "SELECT * FROM counts"))
def _(spark, sf):
    return routing.prediction_counts(data.predictions(spark, sf), fv.STRATEGIES)


@query("agg_19_reported_usage", o.over("""SELECT *, CAST(round_even(input_tokens / CAST(calls AS DOUBLE), 0) AS BIGINT) AS avg_input, CAST(round_even(output_tokens / CAST(calls AS DOUBLE), 0) AS BIGINT) AS avg_output, input_tokens + output_tokens AS total_tokens FROM (
 SELECT provider, strategy, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, count(*) AS calls FROM responses WHERE success GROUP BY ALL)"""))
def _(spark, sf):
    return usage.reported_usage(data.responses(spark, sf))


@query("agg_20_merge_statistics", o.over(_FIRSTS + "SELECT count(*) AS total_questions, count(*) FILTER (succeeded = 0) AS all_failed, count(*) FILTER (succeeded > 0 AND failed > 0) AS partial_failures FROM merged"))
def _(spark, sf):
    return merge.merge_statistics(_outcomes(spark, sf))


@query("agg_20_failure_rows", o.over(_FIRSTS + "SELECT question_id, CASE WHEN succeeded = 0 THEN 'all_failed' ELSE 'partial_failure' END AS kind FROM merged WHERE succeeded = 0 OR failed > 0"))
def _(spark, sf):
    return merge.failure_rows(_outcomes(spark, sf))


@query("agg_21_merged_responses", o.over(_FIRSTS + "SELECT m.question_id, m.question, f.provider, f.response, f.success, f.error, f.attempts FROM merged m JOIN firsts f USING (question_id)"))
def _(spark, sf):
    merged = merge.merged_questions(data.responses(spark, sf), fv.PROVIDERS, "position")
    return merged.select("question_id", "question", F.explode("responses").alias("provider", "r")).select("question_id", "question", "provider", "r.*")


@query("snk_14_consolidated", o.over(_FIRSTS + """, totals AS (SELECT count(*) AS total_questions, count(*) FILTER (succeeded = 0) AS all_failed, count(*) FILTER (succeeded > 0 AND failed > 0) AS partial_failures FROM merged)
SELECT provider, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, any_value(total_questions) AS total_questions, any_value(all_failed) AS all_failed,
 any_value(partial_failures) AS partial_failures, any_value(total_questions) AS results, any_value(all_failed + partial_failures) AS failures, true AS dated FROM responses, totals GROUP BY provider"""))
def _(spark, sf):
    path = scratch_path(spark, "consolidated")
    consolidate.save_consolidated(consolidate.consolidate(data.responses(spark, sf), fv.PROVIDERS, _outcomes(spark, sf)), path)
    header = spark.read.schema(
        "generated_at string, total_questions bigint, all_failed bigint, partial_failures bigint, by_provider map<string, struct<successful: bigint, failed: bigint>>"
    ).json(f"{path}/statistics")
    results = spark.read.schema("question_id bigint").json(f"{path}/results").agg(F.count("question_id")).scalar()
    failures = spark.read.schema("question_id bigint, kind string").json(f"{path}/failures").agg(F.count("question_id")).scalar()
    return header.select(
        F.explode("by_provider").alias("provider", "counts"), "total_questions", "all_failed", "partial_failures",
        results.alias("results"), failures.alias("failures"), (F.col("generated_at") != "").alias("dated"),
    ).select("provider", "counts.*", "total_questions", "all_failed", "partial_failures", "results", "failures", "dated")


@query("agg_22_request_statistics", o.over("""SELECT provider, CAST(sum(attempts) AS BIGINT) AS total_requests, count(*) FILTER (NOT success) AS failures,
 coalesce(round((sum(attempts) - count(*) FILTER (NOT success)) / CAST(nullif(sum(attempts), 0) AS DOUBLE), 6), 0) AS success_rate FROM responses GROUP BY provider"""))
def _(spark, sf):
    return usage.request_statistics(data.responses(spark, sf))


@query("agg_23_failed_questions", o.over("SELECT DISTINCT question_id FROM responses WHERE NOT success AND provider = 'gemini'"))
def _(spark, sf):
    return merge.failed_questions(data.responses(spark, sf), "gemini")


_WEIGHTED = """, cells AS (SELECT ground_truth, predicted, count(*) AS n FROM scored GROUP BY ALL),
labels AS (SELECT ground_truth AS label FROM cells UNION SELECT predicted FROM cells),
per AS (SELECT label, coalesce((SELECT sum(n) FROM cells WHERE ground_truth = label), 0) AS support, coalesce((SELECT sum(n) FROM cells WHERE predicted = label), 0) AS guessed,
  coalesce((SELECT sum(n) FROM cells WHERE predicted = label AND ground_truth = label), 0) AS hits FROM labels),
pr AS (SELECT *, coalesce(hits / nullif(CAST(guessed AS DOUBLE), 0), 0) AS p, coalesce(hits / nullif(CAST(support AS DOUBLE), 0), 0) AS r FROM per),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pr)
SELECT round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1 FROM f"""


@query("agg_24_weighted_scores", o.over(_SCORED + _WEIGHTED))
def _(spark, sf):
    return routing.weighted_scores(data.scored_predictions(spark, sf))


#: Folds of the questions, the template that each fold's training part has most often for a question's first character, and how often it is right.
FOLD_METRICS = """, folded AS (SELECT question_id, substr(question, 1, 1) AS key, expected_template AS t,
  CAST((row_number() OVER (PARTITION BY expected_template ORDER BY md5('42|' || question_id), question_id) - 1) % 3 AS INTEGER) AS fold FROM questions),
parts AS (SELECT question_id, key, t, f, fold <> f AS fitted FROM folded, (SELECT unnest(range(0, 3)) AS f)),
by_key AS (SELECT f, key, t FROM parts WHERE fitted AND key IS NOT NULL GROUP BY f, key, t QUALIFY row_number() OVER (PARTITION BY f, key ORDER BY count(*) DESC, t) = 1),
overall AS (SELECT f, t FROM parts WHERE fitted GROUP BY f, t QUALIFY row_number() OVER (PARTITION BY f ORDER BY count(*) DESC, t) = 1),
answered AS (SELECT parts.f, fitted, parts.t, coalesce(by_key.t, overall.t) AS p FROM parts LEFT JOIN by_key ON parts.f = by_key.f AND parts.key = by_key.key JOIN overall ON parts.f = overall.f),
classes AS (SELECT f, fitted, label, CAST(sum(hit) AS DOUBLE) AS hits, CAST(sum(truth) AS DOUBLE) AS support, CAST(sum(guess) AS DOUBLE) AS guessed FROM (
  SELECT f, fitted, t AS label, CASE WHEN t = p THEN 1 ELSE 0 END AS hit, 1 AS truth, 0 AS guess FROM answered UNION ALL SELECT f, fitted, p, 0, 0, 1 FROM answered) GROUP BY ALL),
scored AS (SELECT f, fitted, support, hits, coalesce(hits / nullif(guessed, 0), 0) AS pr, coalesce(hits / nullif(support, 0), 0) AS re FROM classes),
m AS (SELECT CAST(f + 1 AS INTEGER) AS fold, round(sum(hits) FILTER (fitted) / sum(support) FILTER (fitted), 6) AS train_accuracy,
  round(sum(hits) FILTER (NOT fitted) / sum(support) FILTER (NOT fitted), 6) AS val_accuracy,
  round(sum(support * coalesce(2 * pr * re / nullif(pr + re, 0), 0)) FILTER (NOT fitted) / sum(support) FILTER (NOT fitted), 6) AS val_f1 FROM scored GROUP BY f) """


def lookup_rows(spark, sf):
    """Questions with their first character, which the lookup router goes by."""
    q = data.questions(spark, sf)
    return q.select("question_id", F.substring("question", 1, 1).alias("first"), F.col("expected_template").alias("label_name"))


def fold_metrics(spark, sf):
    """Fold metrics of the lookup router, as its trainer has stored them."""
    candidates = {"lookup": lambda part: routers.train_lookup(part, "first", fv.TEMPLATES)}
    return routers.train_artefact(lookup_rows(spark, sf), candidates, scratch_path(spark, "lookup-router"), 1, "question_id").metrics


@query("agg_25_cv_summary", o.over(FOLD_METRICS + """SELECT round(avg(val_accuracy), 6) AS cv_mean_accuracy, round(stddev_pop(val_accuracy), 6) AS cv_std_accuracy, round(avg(val_f1), 6) AS cv_mean_f1,
 round(avg(train_accuracy - val_accuracy), 6) AS avg_gap, true AS timed FROM m"""))
def _(spark, sf):
    return routing.cv_summary(fold_metrics(spark, sf)).withColumn("timed", F.col("total_time") > 0).drop("total_time")


@query("agg_26_model_comparison", o.over(f""", s AS (SELECT 'simple_neural' AS model, expected_template AS t, {o._TEMPLATE_OF['simple_neural']} AS p FROM questions UNION ALL SELECT 'roberta', expected_template, {o._TEMPLATE_OF['roberta']} FROM questions)
SELECT model, count(*) AS questions, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s GROUP BY model"""))
def _(spark, sf):
    parts = [data.scored_predictions(spark, sf, m).withColumn("model", F.lit(m)) for m in ("simple_neural", "roberta")]
    return routing.model_comparison(parts[0].unionByName(parts[1]))


@query("agg_27_accuracy_by_template", o.over_classified(f"""SELECT provider, template, count(*) FILTER (stage = 'valid' AND extracted IS NOT NULL) AS extractable, count(*) FILTER (stage = 'valid' AND correct) AS correct,
 {o.pct("count(*) FILTER (stage = 'valid' AND correct)", "count(*) FILTER (stage = 'valid' AND extracted IS NOT NULL)", 1)} AS accuracy_pct FROM graded GROUP BY provider, template"""))
def _(spark, sf):
    return quality.accuracy_by_template(_graded(spark, sf))


@query("agg_28_template_mix", o.over(f""", m AS (SELECT strategy, coalesce(template, 'unknown') AS template, count(*) AS n FROM responses WHERE strategy <> 'baseline' GROUP BY ALL),
s AS (SELECT strategy, template, {o.pct('n', 'sum(n) OVER (PARTITION BY strategy)')} AS share FROM m)
SELECT template, coalesce(max(share) FILTER (strategy = 'simple_neural'), 0) AS simple_neural_pct, coalesce(max(share) FILTER (strategy = 'roberta'), 0) AS roberta_pct FROM s GROUP BY template"""))
def _(spark, sf):
    return routing.template_mix(data.responses(spark, sf), ["simple_neural", "roberta"])


@query("agg_29_routing_correlation", o.over(_COUNTS + f""", long AS (SELECT * FROM counts UNPIVOT (n FOR template IN ({', '.join(chr(34) + t + chr(34) for t in fv.TEMPLATES)})))
SELECT round(corr(CAST(a.n AS DOUBLE), CAST(b.n AS DOUBLE)), 6) AS correlation FROM long a JOIN long b USING (template) WHERE a.strategy = 'simple_neural' AND b.strategy = 'roberta'"""))
def _(spark, sf):
    counts = routing.prediction_counts(data.predictions(spark, sf), fv.STRATEGIES)
    return routing.routing_correlation(counts, "simple_neural", "roberta")


_CAPPED = f""", caps(template, cap) AS (VALUES {o._values(fv.LIVE_MAX_TOKENS.items())}),
long AS (SELECT question_id, strategy, template FROM predictions UNPIVOT (template FOR strategy IN (baseline, simple_neural, roberta))),
capped AS (SELECT strategy, CAST(sum(coalesce(cap, 1000)) AS BIGINT) AS total_tokens FROM long LEFT JOIN caps USING (template) GROUP BY strategy) """


@query("agg_30_capped_tokens", o.over(_CAPPED + f"""SELECT c.strategy, c.total_tokens, b.total_tokens - c.total_tokens AS savings, {o.pct('(b.total_tokens - c.total_tokens)', 'b.total_tokens')} AS savings_pct
 FROM capped c JOIN capped b ON b.strategy = 'baseline'"""))
def _(spark, sf):
    long = routing.long_predictions(data.predictions(spark, sf)).where(F.col("template").isNotNull())
    return usage.capped_tokens(long, requests.cap_table(spark))


@query("agg_31_provider_averages", o.over(_ACCURACY + _TOTALS + _SAVINGS + """SELECT strategy, round(avg(accuracy_pct), 4) AS avg_accuracy_pct, round(avg(savings_pct), 4) AS avg_savings_pct
 FROM accuracy JOIN savings USING (provider, strategy) GROUP BY strategy"""))
def _(spark, sf):
    r = data.responses(spark, sf)
    accuracy = routing.router_accuracy(data.predictions(spark, sf), r)
    both = accuracy.join(usage.token_savings(r), ["provider", "strategy"])
    return routing.average_by_strategy(both, "accuracy_pct", "savings_pct")


@query("agg_32_strategies_per_provider", o.over("SELECT provider, count(DISTINCT strategy) AS n_strategies, array_to_string(list_sort(list(DISTINCT strategy)), ', ') AS strategies FROM responses GROUP BY provider"))
def _(spark, sf):
    return merge.strategies_per_provider(data.responses(spark, sf))


@query("agg_33_download_summary", o.over(_LINES_CTE + "SELECT strategy, count(*) AS successful, count(*) AS total FROM lines WHERE status_code = 200 GROUP BY strategy"))
def _(spark, sf):
    rows = readers.batch_responses(readers.parse_batch_lines(_batch_lines(spark, sf)), data.questions(spark, sf))
    return quality.success_rates(rows, ["strategy"]).select("strategy", F.col("succeeded").alias("successful"), "total")


# ---- windows, sorts and sets -------------------------------------------------------------


@query("win_01_first_samples", o.over_classified("""SELECT provider, strategy, kind, question_idx, issue, response, sample_no FROM (
 SELECT provider, strategy, CASE WHEN stage <> 'valid' THEN 'error' ELSE 'non_extractable' END AS kind, question_id AS question_idx, coalesce(issue, 'NO_ANSWER') AS issue,
  CASE WHEN coalesce(response, '') = '' THEN 'NULL' WHEN stage = 'empty' THEN substring(response, 1, 100) WHEN stage = 'error' THEN substring(response, 1, 200) ELSE substring(response, 1, 300) END AS response,
  row_number() OVER (PARTITION BY provider, strategy, CASE WHEN stage <> 'valid' THEN 'error' ELSE 'non_extractable' END ORDER BY question_id) AS sample_no
 FROM graded WHERE stage <> 'valid' OR extracted IS NULL) WHERE sample_no <= 3"""))
def _(spark, sf):
    return quality.issue_samples(facts.classify(data.responses(spark, sf)))


@query("win_01_suspicious_samples", o.over(_SUSPICIOUS + "SELECT *, row_number() OVER (PARTITION BY provider, strategy ORDER BY question_idx) AS sample_no FROM suspicious QUALIFY sample_no <= 3"))
def _(spark, sf):
    return quality.first_rows(quality.suspicious_responses(data.responses(spark, sf)), quality.GROUP, "question_idx")


_SPLIT = """, ranked AS (SELECT question_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || question_id), question_id) AS r, count(*) OVER (PARTITION BY category) AS c FROM questions),
split AS (SELECT question_id, category, CASE WHEN r <= round(c * 0.2) THEN 'test' WHEN r <= round(c * 0.2) + round(c * 0.1) THEN 'val' ELSE 'train' END AS split FROM ranked) """


@query("win_02_stratified_split", o.over(_SPLIT + "SELECT * FROM split"))
def _(spark, sf):
    q = data.questions(spark, sf)
    return _split(q).select("question_id", "category", "split")


def _split(q):
    from gradeloom.operators.ranking import stratified_split

    return stratified_split(q, "question_id", "category")


@query("win_03_stratified_folds", o.over("""SELECT question_id, expected_template, CAST((row_number() OVER (PARTITION BY expected_template ORDER BY md5('42|' || question_id), question_id) - 1) % 3 AS INTEGER) AS fold FROM questions"""))
def _(spark, sf):
    from gradeloom.operators.ranking import stratified_folds

    q = data.questions(spark, sf).select("question_id", "expected_template")
    return stratified_folds(q, "question_id", "expected_template", k=3)


@query("win_04_batches", o.over("SELECT question_id, question_id // 100 + 1 AS batch, question_id // 100 * 100 AS batch_first, question_id // 100 * 100 + 99 AS batch_last FROM questions"))
def _(spark, sf):
    return prepare.with_batches(data.questions(spark, sf).select("question_id"), 100)


@query("win_05_share_in_group", o.over(_MIX.replace("coalesce(template, 'unknown')", "error").replace("error AS template", "coalesce(error, 'none') AS error").replace("GROUP BY provider, strategy, error", "GROUP BY provider, strategy, coalesce(error, 'none')").replace("percentage", "share_pct")))
def _(spark, sf):
    r = data.responses(spark, sf).withColumn("error", F.coalesce("error", F.lit("none")))
    return prepare.distribution(r, ["provider", "strategy", "error"], ["provider", "strategy"])


PROGRESS = o.over("""SELECT provider, strategy, completed, total, round(elapsed, 3) AS elapsed_sec, round(coalesce(completed / nullif(elapsed, 0), 0) * 60, 3) AS rate_per_min,
 round(coalesce((total - completed) / nullif(coalesce(completed / nullif(elapsed, 0), 0) * 60, 0), 0), 3) AS eta_min FROM (
 SELECT provider, strategy, row_number() OVER w AS completed, count(*) OVER (PARTITION BY provider, strategy) AS total,
  (epoch_us(completed_at) - min(epoch_us(completed_at)) OVER (PARTITION BY provider, strategy)) / CAST(1000000 AS DOUBLE) AS elapsed
 FROM request_log WINDOW w AS (PARTITION BY provider, strategy ORDER BY completed_at, event_id)) WHERE completed % 50 = 0 OR completed = total""")


@query("win_06_progress", PROGRESS)
def _(spark, sf):
    from gradeloom.operators.progress import progress_marks

    return progress_marks(data.request_log(spark, sf))


@query("win_07_first_response", o.over("SELECT provider, question_id, question, response, success, error, attempts FROM responses QUALIFY row_number() OVER (PARTITION BY provider, question_id ORDER BY position) = 1"))
def _(spark, sf):
    return merge.first_response(data.responses(spark, sf), "position")


@query("srt_01_ordered_results", o.over(_LINES_CTE + "SELECT question_id, strategy, total_tokens FROM lines WHERE status_code = 200 ORDER BY question_id, strategy"))
def _(spark, sf):
    lines = readers.accepted(readers.parse_batch_lines(_batch_lines(spark, sf)))
    return lines.select("question_id", "strategy", "total_tokens").orderBy("question_id", "strategy")


@query("srt_02_sorted_cells", o.over(_SCORED + "SELECT ground_truth, predicted, count(*) AS n FROM scored GROUP BY ALL ORDER BY ground_truth, predicted"))
def _(spark, sf):
    return routing.confusion(data.scored_predictions(spark, sf, "simple_neural")).orderBy("ground_truth", "predicted")


@query("srt_03_first_questions", o.over("SELECT question_id, category FROM questions WHERE question_id < 100"))
def _(spark, sf):
    return prepare.first_questions(data.questions(spark, sf), 100).select("question_id", "category")


@query("srt_04_sample_report", o.over_classified("""SELECT question_id, substring(question, 1, 100) AS question, coalesce(substring(response, 1, 200), 'NULL') AS response, coalesce(extracted, 'None') AS extracted, key_letter AS ground_truth,
 CASE WHEN extracted IS NOT NULL THEN CASE WHEN extracted IS NOT DISTINCT FROM key_letter THEN 'CORRECT' ELSE 'WRONG' END END AS result
 FROM graded WHERE provider = 'openai' AND strategy = 'baseline' ORDER BY question_id LIMIT 2"""))
def _(spark, sf):
    return quality.sample_report(facts.classify(data.responses(spark, sf)), data.answer_key(spark, sf), "openai", "baseline")


def _parts(spark, sf):
    raw = data.questions_raw(spark, sf)
    return {p: raw.where(F.col("original_split") == p).drop("original_split") for p in ("dev", "validation", "test")}


@query("set_01_union_parts", o.over("SELECT original_split, subject, count(*) AS n FROM questions_raw GROUP BY ALL"))
def _(spark, sf):
    return prepare.union_parts(_parts(spark, sf)).groupBy("original_split", "subject").agg(F.count(F.lit(1)).alias("n"))


@query("set_02_merge_runs", o.over("SELECT provider, strategy, count(*) AS n, count(DISTINCT question_id) AS questions FROM responses GROUP BY ALL"))
def _(spark, sf):
    r = data.responses(spark, sf)
    parts = {p: r.where(F.col("provider") == p).drop("provider") for p in fv.PROVIDERS}
    parts["claude"] = parts["claude"].drop("error")  # a file without the column still merges
    return merge.merge_runs(parts).groupBy("provider", "strategy").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("question_id").alias("questions"))


@query("set_03_union_strategies", o.over(_LINES_CTE + "SELECT strategy, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM lines GROUP BY strategy"))
def _(spark, sf):
    lines = readers.parse_batch_lines(_batch_lines(spark, sf))
    parts = {s: lines.where(F.col("strategy") == s).drop("strategy") for s in fv.STRATEGIES}
    return prepare.union_parts(parts, "strategy").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("total_tokens"))


@query("set_04_labels_seen", o.over(_SCORED + "SELECT ground_truth AS label FROM scored UNION SELECT predicted FROM scored"))
def _(spark, sf):
    return routing.labels_seen(data.scored_predictions(spark, sf))


@query("set_05_missing_providers", o.over("SELECT provider FROM (VALUES ('openai'), ('gemini'), ('claude'), ('mistral')) t(provider) EXCEPT SELECT provider FROM responses"))
def _(spark, sf):
    return merge.missing_providers(spark, [*fv.PROVIDERS, "mistral"], data.responses(spark, sf))

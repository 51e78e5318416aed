"""Projections, text classification and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom import fixed_values as fv
from gradeloom.catalog import data, oracle as o
from gradeloom.catalog.registry import query
from gradeloom.functions import messages as ms, text as tx
from gradeloom.functions.numbers import percent
from gradeloom.operators import facts, merge, prepare, quality, requests, routing, usage
from gradeloom.plans.report import response_facts
from gradeloom.sources import readers


@query("prj_01_subject_category", o.over("SELECT q.question_id, q.subject, s.category FROM questions_raw q JOIN subject_dim s USING (subject)"))
def _(spark, sf):
    raw = data.questions_raw(spark, sf)
    return prepare.map_subjects(raw, prepare.subject_dimension(spark)).select("question_id", "subject", "category")


@query("prj_02_category_template", o.over("SELECT question_id, category, expected_template FROM questions"))
def _(spark, sf):
    return data.questions(spark, sf).select("question_id", "category", "expected_template")


@query("prj_03_lettered_question", o.over(f"""
SELECT question_id, CASE WHEN len(choices) = 0 THEN question ELSE {o.strip(
  "question || chr(10) || chr(10) || array_to_string(list_transform(range(1, least(len(choices), 6) + 1), lambda i: substring('ABCDEF', i, 1) || ') ' || choices[i]), chr(10))")} END AS formatted
FROM questions_raw"""))
def _(spark, sf):
    return data.questions_raw(spark, sf).select(
        "question_id", ms.lettered_question(F.col("question"), F.col("choices")).alias("formatted")
    )


_PROMPT_ROWS = o._values([(f, t, p) for f, ts in fv.PROMPTS.items() for t, p in ts.items()])
_PROMPTED = f""", prompts(family, template, system_prompt) AS (VALUES {_PROMPT_ROWS}),
prompted AS (SELECT r.*, coalesce(p.system_prompt, d.system_prompt) AS system_prompt FROM responses r
 LEFT JOIN prompts p ON p.family = CASE WHEN provider = 'gemini' THEN 'gemini' ELSE 'default' END AND p.template = r.template
 LEFT JOIN prompts d ON d.family = CASE WHEN provider = 'gemini' THEN 'gemini' ELSE 'default' END AND d.template = 'standard')
"""


@query("prj_04_prompt", o.over(_PROMPTED + "SELECT question_id, provider, strategy, system_prompt || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM prompted"))
def _(spark, sf):
    prompted = requests.with_prompts(data.responses(spark, sf), requests.prompt_table(spark))
    return prompted.select("question_id", "provider", "strategy", ms.user_prompt(F.col("system_prompt"), F.col("question")).alias("prompt"))


@query("prj_05_provider_prompt", o.over(_PROMPTED + "SELECT provider, coalesce(template, 'unknown') AS template, system_prompt, count(*) AS n FROM prompted GROUP BY ALL"))
def _(spark, sf):
    prompted = requests.with_prompts(data.responses(spark, sf), requests.prompt_table(spark))
    return prompted.groupBy("provider", F.coalesce("template", F.lit("unknown")).alias("template"), "system_prompt").agg(F.count(F.lit(1)).alias("n"))


def _caps_cte(caps):
    return f", caps(template, max_tokens) AS (VALUES {o._values(caps.items())}) "


@query("prj_06_max_tokens", o.over(_caps_cte(fv.LIVE_MAX_TOKENS) + "SELECT question_id, provider, strategy, coalesce(max_tokens, 1000) AS max_tokens FROM responses LEFT JOIN caps USING (template)"))
def _(spark, sf):
    return requests.with_caps(data.responses(spark, sf), requests.cap_table(spark)).select("question_id", "provider", "strategy", "max_tokens")


_DEFAULTED = "CASE strategy WHEN 'baseline' THEN 'verbose' WHEN 'simple_neural' THEN coalesce(simple_neural, 'verbose') ELSE coalesce(roberta, 'verbose') END"


@query("prj_07_request_lines", o.over(f""", prompts(family, template, system_prompt) AS (VALUES {_PROMPT_ROWS}), caps(template, max_tokens) AS (VALUES {o._values(fv.BATCH_MAX_TOKENS.items())}),
planned AS (SELECT q.*, s.strategy, CASE strategy WHEN 'baseline' THEN 'verbose' WHEN 'simple_neural' THEN coalesce(p.simple_neural, 'standard') ELSE coalesce(p.roberta, 'standard') END AS template
 FROM questions q LEFT JOIN predictions p ON p.question_id = q.question_id CROSS JOIN (VALUES ('baseline'), ('simple_neural'), ('roberta')) s(strategy))
SELECT question_id, strategy, 'q' || question_id || '_' || strategy AS custom_id, 'gpt-4o-mini' AS model, 'system' AS first_role, system_prompt AS first_content, 'user' AS second_role,
 CASE WHEN len(choices) = 0 THEN question ELSE {o.strip("question || chr(10) || chr(10) || array_to_string(list_transform(range(1, least(len(choices), 6) + 1), lambda i: substring('ABCDEF', i, 1) || ') ' || choices[i]), chr(10))")} END AS second_content,
 max_tokens, 0.0 AS temperature
FROM planned JOIN prompts ON family = 'default' AND prompts.template = planned.template JOIN caps ON caps.template = planned.template"""))
def _(spark, sf):
    calls = requests.planned_calls(
        data.questions(spark, sf), data.predictions(spark, sf), providers=["openai"], caps=fv.BATCH_MAX_TOKENS
    )
    lines = requests.request_lines(calls)
    shape = (
        "custom_id string, method string, url string, body struct<model:string, "
        "messages:array<struct<role:string, content:string>>, max_tokens:int, temperature:double>"
    )
    parsed = lines.select(F.from_json("value", shape).alias("j"))
    first, second = F.col("j.body.messages")[0], F.col("j.body.messages")[1]
    return parsed.select(
        ms.custom_id_question(F.col("j.custom_id")).alias("question_id"),
        ms.custom_id_strategy(F.col("j.custom_id")).alias("strategy"),
        F.col("j.custom_id").alias("custom_id"),
        F.col("j.body.model").alias("model"),
        first["role"].alias("first_role"),
        first["content"].alias("first_content"),
        second["role"].alias("second_role"),
        second["content"].alias("second_content"),
        F.col("j.body.max_tokens").alias("max_tokens"),
        F.col("j.body.temperature").alias("temperature"),
    )


@query("prj_08_custom_id", o.over("""SELECT DISTINCT 'q' || question_id || '_' || strategy AS custom_id,
 CAST(substring(split_part('q' || question_id || '_' || strategy, '_', 1), 2) AS BIGINT) AS parsed_id, strategy AS parsed_strategy FROM responses"""))
def _(spark, sf):
    made = data.responses(spark, sf).select(ms.custom_id(F.col("question_id"), F.col("strategy")).alias("custom_id")).distinct()
    return made.select(
        "custom_id",
        ms.custom_id_question(F.col("custom_id")).alias("parsed_id"),
        ms.custom_id_strategy(F.col("custom_id")).alias("parsed_strategy"),
    )


def _batch_lines(spark, sf):
    """Responses of one provider as batch output lines; failures carry another status."""
    usage_part = F.when(F.col("question_id") % 5 != 2, F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"), (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens")))
    return merge.select_work(data.responses(spark, sf), provider="openai").select(
        ms.custom_id(F.col("question_id"), F.col("strategy")).alias("custom_id"),
        F.struct(
            F.when(F.col("success"), 200).otherwise(503).alias("status_code"),
            F.struct(F.array(F.struct(F.struct(F.col("response").alias("content")).alias("message"))).alias("choices"), usage_part.alias("usage")).alias("body"),
        ).alias("response"),
    )


_LINES_CTE = """, lines AS (SELECT 'q' || question_id || '_' || strategy AS custom_id, question_id, strategy, CASE WHEN success THEN 200 ELSE 503 END AS status_code, response,
 CASE WHEN question_id % 5 <> 2 THEN coalesce(input_tokens, 0) ELSE 0 END AS input_tokens, CASE WHEN question_id % 5 <> 2 THEN coalesce(output_tokens, 0) ELSE 0 END AS output_tokens,
 CASE WHEN question_id % 5 <> 2 THEN coalesce(input_tokens + output_tokens, 0) ELSE 0 END AS total_tokens FROM responses WHERE provider = 'openai') """


@query("prj_09_response_fields", o.over(_LINES_CTE + "SELECT custom_id, status_code, response, input_tokens, output_tokens, total_tokens FROM lines"))
def _(spark, sf):
    return readers.parse_batch_lines(_batch_lines(spark, sf)).drop("question_id", "strategy")


@query("prj_10_normalised_rows", o.over("""SELECT question_id, provider, strategy, template, response, success, error, attempts, input_tokens, output_tokens FROM responses"""))
def _(spark, sf):
    rows = data.responses(spark, sf)
    won = facts.normalise(rows.where("success").drop("error"))
    lost = facts.normalise(rows.where("NOT success").drop("input_tokens", "output_tokens", "response"))
    return won.unionByName(lost).drop("question")


@query("prj_11_answer_letter", o.over("SELECT question_id, (['A', 'B', 'C', 'D'])[answer + 1] AS letter FROM questions"))
def _(spark, sf):
    return data.questions(spark, sf).select("question_id", tx.answer_letter(F.col("answer")).alias("letter"))


@query("prj_12_previews", o.over("SELECT question_id, provider, strategy, " + ", ".join(f"coalesce(substring(response, 1, {n}), 'NULL') AS preview_{n}" for n in (80, 100, 150, 200, 300)) + " FROM responses"))
def _(spark, sf):
    return data.responses(spark, sf).select(
        "question_id", "provider", "strategy", *[tx.preview(F.col("response"), n).alias(f"preview_{n}") for n in (80, 100, 150, 200, 300)]
    )


@query("prj_13_token_estimate", o.over(f"SELECT question_id, provider, strategy, {o.token_estimate('response')} AS tokens FROM responses"))
def _(spark, sf):
    return data.responses(spark, sf).select("question_id", "provider", "strategy", tx.token_estimate(F.col("response")).alias("tokens"))


@query("prj_14_token_bucket", o.over(f"SELECT provider, strategy, {o.bucket('coalesce(output_tokens, 0)')} AS bucket, count(*) AS n FROM responses WHERE success GROUP BY ALL"))
def _(spark, sf):
    rows = data.responses(spark, sf).where("success")
    return rows.groupBy("provider", "strategy", tx.token_bucket(quality.reported_tokens()).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_15_percent", o.over(f"SELECT question_id, {o.pct('count(*) FILTER (success)', 'count(*)')} AS success_pct, {o.pct('sum(output_tokens) FILTER (output_tokens < 20)', 'sum(output_tokens)')} AS low_share_pct FROM responses GROUP BY question_id"))
def _(spark, sf):
    low = F.sum(F.when(F.col("output_tokens") < 20, F.col("output_tokens")))
    return data.responses(spark, sf).groupBy("question_id").agg(
        percent(F.count_if("success"), F.count(F.lit(1))).alias("success_pct"),
        percent(low, F.sum("output_tokens")).alias("low_share_pct"),
    )


_TOTALS = f""", totals AS (SELECT provider, strategy,
  CAST(coalesce(sum(CASE WHEN success AND response <> '' THEN {o.token_estimate('response')} END), 0) AS BIGINT) AS total_tokens,
  count(*) FILTER (success AND response <> '') AS counted FROM responses GROUP BY ALL),
 prices(provider, price) AS (VALUES {o._values(fv.FIGURE_OUTPUT_PRICE.items())}) """


@query("prj_16_output_cost", o.over(_TOTALS + """SELECT t.provider, t.strategy, t.total_tokens, round(t.total_tokens / CAST(1000000 AS DOUBLE) * price, 6) AS cost,
 coalesce(round((CAST(b.total_tokens AS DOUBLE) - t.total_tokens) / nullif(b.total_tokens, 0) * 100, 1), 0) AS cost_savings_pct
FROM totals t JOIN prices USING (provider) LEFT JOIN totals b ON b.provider = t.provider AND b.strategy = 'baseline'"""))
def _(spark, sf):
    totals = usage.token_totals(data.responses(spark, sf))
    return usage.output_cost(totals, usage.output_prices(spark)).select("provider", "strategy", "total_tokens", "cost", "cost_savings_pct")


@query("prj_17_call_cost", o.over(f""", prices(provider, pin, pout) AS (VALUES {o._values([(p, i, x) for p, (i, x) in fv.TESTING_PRICE.items()])}),
used AS (SELECT provider, sum(input_tokens) AS i, sum(output_tokens) AS x FROM responses WHERE success GROUP BY provider)
SELECT provider, round(i / 1e6 * pin, 6) AS input_cost, round(x / 1e6 * pout, 6) AS output_cost, round(i / 1e6 * pin + x / 1e6 * pout, 6) AS total_cost,
 round((i / 1e6 * pin + x / 1e6 * pout) * 0.5, 6) AS batch_cost FROM used JOIN prices USING (provider)"""))
def _(spark, sf):
    return usage.call_cost(usage.reported_usage(data.responses(spark, sf)))


@query("prj_18_routing_truth", o.over("SELECT question_id, coalesce(ground_truth, baseline, 'standard') AS truth FROM predictions"))
def _(spark, sf):
    return routing.routing_truth(data.predictions(spark, sf))


@query("prj_19_provider_label", o.over("""SELECT CASE provider WHEN 'openai' THEN 'OpenAI-GPT4omini' WHEN 'claude' THEN 'Anthropic-Haiku' ELSE 'Google-gemini-2.0-flash-lite' END AS label,
 count(*) AS n FROM responses GROUP BY 1"""))
def _(spark, sf):
    models = prepare.dimension(spark, fv.PROVIDER_MODEL, "provider", "model")
    labelled = data.responses(spark, sf).select("provider").join(models, "provider")
    return labelled.groupBy(ms.provider_label(F.col("provider"), F.col("model")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_FUNNEL_SUMS = """count(*) AS total, count(*) FILTER (stage = 'empty') AS empty, count(*) FILTER (stage = 'error') AS errors,
 count(*) FILTER (stage = 'valid') AS valid, count(*) FILTER (stage = 'valid' AND extracted IS NOT NULL) AS extractable,
 count(*) FILTER (stage = 'valid' AND extracted IS NULL) AS non_extractable, count(*) FILTER (stage = 'valid' AND correct) AS correct,
 count(*) FILTER (stage = 'valid' AND NOT correct) AS incorrect"""


@query("prj_20_dataset_verdict", o.over_classified(f""", f AS (SELECT {_FUNNEL_SUMS} FROM graded)
SELECT {o.pct('valid', 'total')} AS valid_rate_pct, {o.pct('extractable', 'total')} AS extraction_rate_pct,
 CASE WHEN valid * 100 >= 99 * total AND extractable * 100 >= 95 * total THEN 'EXCELLENT' WHEN valid * 100 >= 95 * total AND extractable * 100 >= 85 * total THEN 'GOOD' ELSE 'ISSUES' END AS verdict FROM f"""))
def _(spark, sf):
    return quality.dataset_verdict(quality.funnel(response_facts(data.responses(spark, sf), data.answer_key(spark, sf))))


@query("prj_21_run_verdict", o.over_classified(f""", f AS (SELECT count(*) AS total, count(extracted) AS extractable, count(*) FILTER (correct) AS correct FROM graded)
SELECT total, extractable, correct, {o.pct('extractable', 'total', 1)} AS extraction_pct, {o.pct('correct', 'extractable', 1)} AS accuracy_pct,
 CASE WHEN extractable * 100 >= 85 * total THEN 'SUCCESS' WHEN extractable * 100 >= 50 * total THEN 'PARTIAL' ELSE 'FAIL' END AS verdict,
 correct * 100 >= 70 * extractable AS accuracy_ok FROM f"""))
def _(spark, sf):
    return quality.run_verdict(quality.raw_extraction(response_facts(data.responses(spark, sf), data.answer_key(spark, sf))))


def _jobs(spark, sf):
    """The request log as batch jobs, one per provider, strategy and day."""
    log = data.request_log(spark, sf)
    day = F.to_date("completed_at")
    jobs = log.groupBy("provider", "strategy", day.cast("string").alias("day")).agg(
        F.count_if("success").alias("completed"), F.count(F.lit(1)).alias("total")
    )
    state = (F.col("completed") * 7 + F.col("total")) % 9
    names = F.array(*[F.lit(s) for s in ["validating", "in_progress", "finalizing", "completed", "failed", "expired", "cancelling", "cancelled", "paused"]])
    return jobs.withColumn("status", F.get(names, state.cast("int")))


_JOBS_CTE = """, jobs0 AS (SELECT provider, strategy, CAST(CAST(completed_at AS DATE) AS VARCHAR) AS day, count(*) FILTER (success) AS completed, count(*) AS total FROM request_log GROUP BY ALL),
jobs AS (SELECT *, (['validating', 'in_progress', 'finalizing', 'completed', 'failed', 'expired', 'cancelling', 'cancelled', 'paused'])[CAST((completed * 7 + total) % 9 AS INTEGER) + 1] AS status FROM jobs0) """


@query("prj_22_batch_progress", o.over(_JOBS_CTE + f"""SELECT provider, strategy, day, completed, total, status, {o.pct('completed', 'total', 1)} AS percent_done,
 CASE WHEN status = 'completed' THEN 'done' WHEN status IN ('failed', 'expired', 'cancelled') THEN 'stopped' WHEN status IN ('validating', 'in_progress', 'finalizing', 'cancelling') THEN 'pending' ELSE 'unknown' END AS state FROM jobs"""))
def _(spark, sf):
    return requests.batch_progress(_jobs(spark, sf))


@query("prj_24_improvement", o.over("""SELECT strategy, accuracy, round(accuracy - 0.883, 6) AS improvement, round((accuracy - 0.883) / 0.883 * 100, 4) AS improvement_pct,
 CASE WHEN accuracy > 0.883 THEN round((accuracy - 0.883) * 100 * 93, 2) ELSE 0 END AS savings_per_million FROM (
 SELECT strategy, CAST(count(*) FILTER (template = expected_template) AS DOUBLE) / count(*) AS accuracy FROM responses JOIN questions USING (question_id) GROUP BY strategy)"""))
def _(spark, sf):
    q = data.questions(spark, sf).select("question_id", "expected_template")
    used = data.responses(spark, sf).select("question_id", "strategy", "template").join(q, "question_id")
    hits = F.count_if(F.coalesce(F.col("template") == F.col("expected_template"), F.lit(False)))
    accuracy = used.groupBy("strategy").agg((hits / F.count(F.lit(1))).alias("accuracy"))
    return routing.improvement_over_reference(accuracy)


# ---- response text -----------------------------------------------------------------------


@query("str_01_answer_choice", o.over_classified("SELECT question_id, provider, strategy, extracted FROM classified"))
def _(spark, sf):
    return facts.classify(data.responses(spark, sf)).select("question_id", "provider", "strategy", F.col("answer").alias("extracted"))


@query("str_02_api_error", o.over_classified(f"SELECT question_id, provider, strategy, {o.api_error('response', 'body')} AS issue FROM stripped"))
def _(spark, sf):
    prepared = data.responses(spark, sf).withColumn("head", tx.error_head(F.col("response"))).withColumn("body", tx.stripped(F.col("response")))
    issue = tx.api_error(F.col("response"), F.col("body"), F.col("head"))
    return prepared.select("question_id", "provider", "strategy", issue.alias("issue"))


@query("str_03_likely_error", o.over(f"SELECT question_id, provider, strategy, coalesce({o.likely_error('response')}, false) AS likely_error FROM responses"))
def _(spark, sf):
    lowered = data.responses(spark, sf).withColumn("low", F.lower("response"))
    return lowered.select("question_id", "provider", "strategy", tx.likely_error(F.col("low")).alias("likely_error"))


@query("str_04_blank", o.over_classified("SELECT question_id, provider, strategy, coalesce(body, '') = '' AS blank FROM stripped"))
def _(spark, sf):
    return data.responses(spark, sf).select("question_id", "provider", "strategy", tx.is_blank(F.col("response")).alias("blank"))


# ---- filters -----------------------------------------------------------------------------


@query("flt_01_unmapped_subjects", o.over("SELECT subject, count(*) AS n FROM questions_raw WHERE subject NOT IN (SELECT subject FROM subject_dim) GROUP BY subject"))
def _(spark, sf):
    lost = prepare.unmapped_questions(data.questions_raw(spark, sf), prepare.subject_dimension(spark))
    return lost.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("flt_02_answered", o.over("SELECT question_id, provider, strategy FROM responses WHERE success AND response <> ''"))
def _(spark, sf):
    return usage.answered(data.responses(spark, sf)).select("question_id", "provider", "strategy")


@query("flt_03_low_tokens", o.over("SELECT question_id, provider, strategy, coalesce(output_tokens, 0) AS output_tokens FROM responses WHERE success AND coalesce(output_tokens, 0) < 20"))
def _(spark, sf):
    low = quality.low_token_responses(data.responses(spark, sf))
    return low.select("question_id", "provider", "strategy", quality.reported_tokens().alias("output_tokens"))


@query("flt_04_selected_work", o.over("SELECT question_id, provider, strategy, attempts FROM responses WHERE provider = 'gemini' AND strategy = 'roberta'"))
def _(spark, sf):
    return merge.select_work(data.responses(spark, sf), "gemini", "roberta").select("question_id", "provider", "strategy", "attempts")


@query("flt_05_accepted_rejected", o.over(_LINES_CTE + "SELECT strategy, status_code = 200 AS accepted, count(*) AS n FROM lines GROUP BY ALL"))
def _(spark, sf):
    lines = readers.parse_batch_lines(_batch_lines(spark, sf))
    both = readers.accepted(lines).withColumn("accepted", F.lit(True)).unionByName(readers.rejected(lines).withColumn("accepted", F.lit(False)))
    return both.groupBy("strategy", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("flt_06_all_complete", o.over(_JOBS_CTE + "SELECT provider, bool_and(status = 'completed') AS all_complete FROM jobs GROUP BY provider"))
def _(spark, sf):
    return requests.all_complete(_jobs(spark, sf), ["provider"])


@query("flt_07_wrong_sizes", o.over("SELECT provider, strategy, count(*) AS n FROM responses WHERE success GROUP BY ALL HAVING count(*) <> (SELECT count(*) FROM questions)"))
def _(spark, sf):
    expected = data.questions(spark, sf).count()
    return merge.wrong_sizes(data.responses(spark, sf).where("success"), expected)


@query("flt_08_groups_with_issues", o.over("""SELECT provider, strategy, count(*) FILTER (NOT success) AS failed_responses, count(*) FILTER (success AND coalesce(output_tokens, 0) < 20) AS low_token_responses
FROM responses GROUP BY ALL HAVING count(*) FILTER (NOT success) > 0 OR count(*) FILTER (success AND coalesce(output_tokens, 0) < 20) > 0"""))
def _(spark, sf):
    return quality.groups_with_issues(quality.validation_stats(data.responses(spark, sf))).select(
        "provider", "strategy", "failed_responses", "low_token_responses"
    )

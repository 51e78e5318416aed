"""Sources and sinks: everything is written below the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom import fixed_values as fv, schemas
from gradeloom.catalog import data, oracle as o
from gradeloom.catalog.aggregates import _COUNTS, _HEADER, _MIX, _STATS, _SUCCESS, _SUSPICIOUS, _TOTALS, _SAVINGS, _ACCURACY, _AGREEMENT, _split
from gradeloom.catalog.expressions import _LINES_CTE, _PROMPT_ROWS, _batch_lines
from gradeloom.catalog.registry import query
from gradeloom.operators import merge, prepare, quality, requests, routing
from gradeloom.plans import report
from gradeloom.session import scratch_path
from gradeloom.sinks import writers
from gradeloom.sources import readers
from gradeloom.stores import response_cache


def _embedded_split(spark, sf):
    """Split questions that have an embedding."""
    with_vectors = prepare.with_embeddings(data.questions(spark, sf), data.question_embeddings(spark, sf))
    return _split(with_vectors)


_EMBEDDED_SPLIT = """, embedded AS (SELECT q.*, embedding FROM questions q JOIN embeddings ON vec_id = question_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || question_id), question_id) AS r, count(*) OVER (PARTITION BY category) AS c FROM embedded),
split AS (SELECT *, CASE WHEN r <= round(c * 0.2) THEN 'test' WHEN r <= round(c * 0.2) + round(c * 0.1) THEN 'val' ELSE 'train' END AS split FROM ranked) """


# ---- sources -----------------------------------------------------------------------------


@query("src_01_question_documents", o.over(_EMBEDDED_SPLIT + "SELECT question_id, split, question, subject, expected_template, array_to_string(choices, '|') AS choices, answer, len(embedding) AS dims, CAST(embedding[1] AS DOUBLE) AS first_value FROM split"))
def _(spark, sf):
    path = scratch_path(spark, "question-documents")
    writers.write_question_documents(_embedded_split(spark, sf), path)
    return readers.read_question_documents(spark, path).select(
        "question_id", "split", "question", "subject", "expected_template", F.array_join("choices", "|").alias("choices"), "answer",
        F.size("embedding").alias("dims"), F.col("embedding")[0].cast("double").alias("first_value"),
    )


@query("src_02_training_questions", o.over(_EMBEDDED_SPLIT + "SELECT question_id, category, len(embedding) AS dims FROM split WHERE split = 'train'"))
def _(spark, sf):
    path = scratch_path(spark, "splits")
    writers.write_splits(_embedded_split(spark, sf), path)
    return readers.read_training_questions(spark, f"{path}/questions").select("question_id", "category", F.size("embedding").alias("dims"))


@query("src_03_first_questions", o.over("SELECT question_id, category, len(embedding) AS dims FROM questions JOIN embeddings ON vec_id = question_id WHERE question_id < 100"))
def _(spark, sf):
    first = prepare.first_questions(data.questions(spark, sf), 100)
    joined = prepare.with_embeddings(first, prepare.first_questions(data.question_embeddings(spark, sf), 100))
    return joined.select("question_id", "category", F.size("embedding").alias("dims"))


_RESPONSE_COLUMNS = ["question_id", "provider", "strategy", "template", "response", "success", "error", "attempts", "input_tokens", "output_tokens"]
_RESPONSE_SQL = "SELECT " + ", ".join(_RESPONSE_COLUMNS) + " FROM responses"


@query("src_04_results_documents", o.over(_RESPONSE_SQL))
def _(spark, sf):
    path = scratch_path(spark, "results-documents")
    writers.write_indented_results(data.responses(spark, sf), path, files=4, compression="gzip")
    flat = readers.read_indented_results(spark, path)
    return flat.where(F.col("question_id").isNotNull()).select(*_RESPONSE_COLUMNS)


@query("src_05_largest_run", o.over(f"{_SUCCESS}, 100 AS run FROM responses WHERE strategy = 'roberta' GROUP BY ALL"))
def _(spark, sf):
    """Runs n2, n10 and n100: the numerically largest is chosen, not the last by name."""
    path = scratch_path(spark, "runs")
    r = data.responses(spark, sf)
    for n, strategy in ((2, "baseline"), (10, "simple_neural"), (100, "roberta")):
        documents = writers.results_documents(merge.select_work(r, strategy=strategy))
        writers.write_lines(documents, f"{path}/run_n{n}_results.json", "gzip")
    chosen = readers.choose_run(spark, path)
    number = int(chosen.rsplit("_n", 1)[1].split("_")[0])
    rates = quality.success_rates(readers.read_results(spark, chosen))
    return rates.drop("success_rate_pct").withColumn("run", F.lit(number))


@query("src_06_optional_answer_key", o.over_classified("SELECT provider, strategy, count(*) AS total, count(*) FILTER (stage = 'valid' AND extracted IS NOT NULL) AS extractable, 0 AS correct, 0 AS incorrect FROM graded GROUP BY ALL"))
def _(spark, sf):
    graded = report.response_facts(data.responses(spark, sf), None)
    return quality.funnel(graded).select("provider", "strategy", "total", "extractable", "correct", "incorrect")


@query("src_07_predictions", o.over("SELECT question_id, ground_truth, baseline, simple_neural, roberta FROM predictions"))
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    data.predictions(spark, sf).write.json(path)
    missing = readers.read_predictions(spark, f"{path}-absent")
    return readers.read_predictions(spark, path).unionByName(missing).drop("question")


@query("src_08_batch_lines", o.over(_LINES_CTE + "SELECT custom_id, question_id, strategy, status_code, response, input_tokens, output_tokens, total_tokens FROM lines"))
def _(spark, sf):
    path = scratch_path(spark, "batch-lines")
    _batch_lines(spark, sf).write.json(path)
    return readers.read_batch_lines(spark, path)


@query("src_09_saved_questions", o.over("SELECT question_id, question FROM questions"))
def _(spark, sf):
    path = scratch_path(spark, "question-list")
    writers.write_question_list(data.questions(spark, sf), path)
    return readers.read_question_list(spark, path)


def _cache_rows(spark, sf, strategy="baseline"):
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("attempts") * 60)
    return data.responses(spark, sf).where(F.col("strategy") == strategy).select(
        "question_id", "question", "provider", stamp.alias("timestamp"), "response", "success", "error", "attempts"
    )


def _filled_cache(spark, sf, *strategies):
    """A bucketed cache that the answers of some strategies were put into, one strategy after the other."""
    path = scratch_path(spark, "cache")
    response_cache.create(spark, path, 16)
    for strategy in strategies:
        response_cache.upsert(spark, path, _cache_rows(spark, sf, strategy))
    return path


@query("src_10_response_cache", o.over("SELECT question_id, provider, response, success, attempts FROM responses WHERE strategy = 'baseline' AND provider = 'gemini'"))
def _(spark, sf):
    path = _filled_cache(spark, sf, "baseline")
    return response_cache.entries(spark, path).where("provider = 'gemini'").select("question_id", "provider", "response", "success", "attempts")


@query("src_10_cache_lookup", o.over("SELECT question_id, provider, response, success, attempts FROM responses WHERE strategy = 'baseline' AND question_id = (SELECT max(question_id) FROM responses) AND provider IN ('gemini', 'openai')"))
def _(spark, sf):
    """One question of two providers; each lookup opens one bucket."""
    path = _filled_cache(spark, sf, "baseline")
    number = data.questions(spark, sf).agg(F.max("question_id")).first()[0]
    found = response_cache.lookup(spark, path, "gemini", number).unionByName(response_cache.lookup(spark, path, "openai", number))
    return found.select("question_id", "provider", "response", "success", "attempts")


@query("src_11_provider_files", o.over("SELECT provider, strategy, count(*) AS n, 'claude' AS missing FROM responses WHERE provider <> 'claude' GROUP BY ALL"))
def _(spark, sf):
    path = scratch_path(spark, "provider-files")
    r = data.responses(spark, sf).drop("position")
    for provider in ("openai", "gemini"):
        merge.select_work(r, provider=provider).write.json(f"{path}/{provider}", compression="gzip")
    merged, missing = readers.read_provider_results(spark, {p: f"{path}/{p}" for p in fv.PROVIDERS})
    return merged.groupBy("provider", "strategy").agg(F.count(F.lit(1)).alias("n")).withColumn("missing", F.lit(",".join(missing)))


@query("src_12_corpus_parts", o.over("SELECT original_split, count(*) AS n, CAST(sum(question_id) AS BIGINT) AS id_sum FROM questions_raw GROUP BY original_split"))
def _(spark, sf):
    path = scratch_path(spark, "corpus")
    data.questions_raw(spark, sf).write.partitionBy("original_split").parquet(path)
    parts = {p: f"{path}/original_split={p}" for p in ("dev", "validation", "test")}
    corpus = readers.read_corpus(spark, parts)
    return corpus.groupBy("original_split").agg(F.count(F.lit(1)).alias("n"), F.sum("question_id").alias("id_sum"))


@query("src_13_list_objects", o.over("SELECT DISTINCT category, true AS has_content FROM questions"))
def _(spark, sf):
    path = scratch_path(spark, "objects")
    data.questions(spark, sf).write.partitionBy("category").parquet(path)
    files = readers.list_objects(spark, path)
    return files.groupBy(F.regexp_extract("path", "category=([a-z]+)/", 1).alias("category")).agg((F.sum("length") > 0).alias("has_content"))


# ---- sinks -------------------------------------------------------------------------------


@query("snk_01_splits", o.over(_EMBEDDED_SPLIT + """SELECT question_id, split, count(*) OVER (PARTITION BY split) AS total_questions, max(len(embedding)) OVER (PARTITION BY split) AS embedding_dim,
 'stratified_70_10_20' AS split_strategy, CAST(list_max(embedding) AS DOUBLE) AS largest_value FROM split"""))
def _(spark, sf):
    path = scratch_path(spark, "splits")
    writers.write_splits(_embedded_split(spark, sf), path)
    header = spark.read.schema("split string, total_questions bigint, embedding_dim int, split_strategy string").json(f"{path}/metadata")
    saved = readers.read_questions(spark, f"{path}/questions").select("question_id", "split", F.array_max("embedding").cast("double").alias("largest_value"))
    return saved.join(F.broadcast(header), "split")  # three splits


@query("snk_02_run_results", o.over("SELECT provider, strategy, question_id, response, output_tokens, (SELECT count(*) FROM questions) AS num_questions FROM responses"))
def _(spark, sf):
    path = scratch_path(spark, "run-results")
    n = data.questions(spark, sf).count()
    writers.write_results(data.responses(spark, sf), path, n)
    saved = spark.read.parquet(path)
    return saved.select("provider", "strategy", "question_id", "response", "output_tokens", F.col("num_questions").cast("long"))


@query("snk_03_prediction_files", o.over(_COUNTS + "SELECT * FROM counts"))
def _(spark, sf):
    path = scratch_path(spark, "router-output")
    predictions = data.predictions(spark, sf)
    writers.write_predictions(predictions, routing.prediction_counts(predictions, fv.STRATEGIES), path)
    fields = ", ".join(f"{t} bigint" for t in fv.TEMPLATES)
    return spark.read.schema(f"strategy string, {fields}, total bigint").json(f"{path}/prediction_counts")


_CALLS = f""", prompts(family, template, system_prompt) AS (VALUES {_PROMPT_ROWS}),
calls AS (SELECT q.question_id, s.strategy, CASE strategy WHEN 'baseline' THEN 'verbose' WHEN 'simple_neural' THEN coalesce(p.simple_neural, 'standard') ELSE coalesce(p.roberta, 'standard') END AS template
 FROM questions q LEFT JOIN predictions p ON p.question_id = q.question_id CROSS JOIN (VALUES ('baseline'), ('simple_neural'), ('roberta')) s(strategy)) """


@query("snk_04_request_file", o.over(_CALLS + """SELECT 'q' || question_id || '_' || strategy AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, system_prompt
 FROM calls JOIN prompts ON family = 'default' AND prompts.template = calls.template"""))
def _(spark, sf):
    path = scratch_path(spark, "requests")
    calls = requests.planned_calls(data.questions(spark, sf), data.predictions(spark, sf), providers=["openai"], caps=fv.BATCH_MAX_TOKENS)
    writers.write_lines(requests.request_lines(calls), path)
    lines = spark.read.schema("custom_id string, method string, url string, body struct<messages:array<struct<role:string, content:string>>>").json(path)
    return lines.select("custom_id", "method", "url", F.col("body.messages")[0]["content"].alias("system_prompt"))


@query("snk_05_summary_csv", o.over(_MIX))
def _(spark, sf):
    path = scratch_path(spark, "summary-csv")
    writers.write_summary_csv(quality.template_distribution(data.responses(spark, sf)), path)
    return spark.read.option("header", True).schema("provider string, strategy string, template string, n bigint, percentage double").csv(path)


@query("snk_06_nested_report", o.over(_STATS + "SELECT provider, strategy, total_responses, low_token_responses, avg_tokens, median_tokens FROM stats"))
def _(spark, sf):
    path = scratch_path(spark, "nested-report")
    writers.write_lines(writers.nested_report(quality.validation_stats(data.responses(spark, sf))), path)
    shape = "map<string, map<string, struct<total_responses:bigint, low_token_responses:bigint, avg_tokens:double, median_tokens:int>>>"
    nested = spark.read.text(path).select(F.explode(F.from_json("value", shape)).alias("provider", "m"))
    return nested.select("provider", F.explode("m").alias("strategy", "v")).select("provider", "strategy", "v.*")


_K = "provider, strategy"
_REPORT_SQL = f""", stat AS (SELECT s.*, coalesce(e.likely_errors, 0) AS likely_errors FROM stats s LEFT JOIN (SELECT {_K}, count(*) FILTER (likely_error) AS likely_errors FROM suspicious GROUP BY ALL) e USING ({_K})
  WHERE failed_responses > 0 OR low_token_responses > 0),
samples AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY question_idx) AS sample_no FROM suspicious QUALIFY sample_no <= 3),
success AS ({_SUCCESS}, {o.pct('count(*) FILTER (success)', 'count(*)')} AS rate FROM responses GROUP BY ALL),
header AS ({_HEADER})
SELECT 1 AS section, {_K}, 1 AS ord, 0 AS sub, printf('%s / %s: %d failed, %d below 20 tokens, %d of them look like errors', provider, strategy, failed_responses, low_token_responses, likely_errors) AS line FROM stat
UNION ALL SELECT 1, {_K}, 2, sample_no, '  Q' || question_idx || ': ' || output_tokens || ' tokens - ' || substring(response_preview, 1, 80) FROM samples
UNION ALL SELECT 1, {_K}, 3, 0, printf('  tokens min=%d avg=%.1f max=%d; <20: %d, 20-100: %d, 100-300: %d, >300: %d', min_tokens, avg_tokens, max_tokens, tokens_lt_20, tokens_20_100, tokens_100_300, tokens_ge_300) FROM stat
UNION ALL SELECT 2, '', '', 1, 0, printf('questions %d, providers %d, strategies %d, calls %d', questions, providers, strategies, total_calls) FROM header
UNION ALL SELECT 3, {_K}, 1, 0, printf('%s / %s: %.2f%% of predictions match (%d)', provider, strategy, accuracy_pct, matches) FROM accuracy
UNION ALL SELECT 3, provider, '', 2, 0, printf('%s: routers agree on %.2f%%', provider, agreement_pct) FROM agreement
UNION ALL SELECT 4, {_K}, 1, 0, printf('%s / %s: %s tokens (avg %d), saves %s (%.2f%%)', provider, strategy, format('{{:,}}', total_tokens), avg_tokens, format('{{:,}}', savings), savings_pct) FROM savings
UNION ALL SELECT 5, {_K}, 1, 0, printf('%s / %s: %d/%d (%.2f%%)', provider, strategy, succeeded, total, rate) FROM success"""


@query("snk_07_text_report", o.over(_STATS + _SUSPICIOUS + _ACCURACY + _AGREEMENT + _TOTALS + _SAVINGS + _REPORT_SQL))
def _(spark, sf):
    return report.ordered_report(report.report_lines(data.responses(spark, sf), data.predictions(spark, sf)))


@query("snk_08_cache_upsert", o.over("""SELECT provider, question_id, response, attempts AS ts FROM responses WHERE strategy IN ('baseline', 'simple_neural')
 QUALIFY row_number() OVER (PARTITION BY provider, question_id ORDER BY attempts DESC, strategy DESC) = 1"""))
def _(spark, sf):
    """Two strategies' answers after each other, told apart by their text: the later timestamp stays, on a tie the later write."""
    path = _filled_cache(spark, sf, "baseline", "simple_neural")
    state = response_cache.entries(spark, path)
    return state.select("provider", "question_id", "response", ((F.unix_seconds("timestamp") - 1704067200) / 60).cast("int").alias("ts"))


@query("snk_09_provider_results", o.over("SELECT provider, count(*) AS total_questions, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, count(response) AS saved_responses FROM responses GROUP BY provider"))
def _(spark, sf):
    path = scratch_path(spark, "provider-results")
    writers.write_provider_results(data.responses(spark, sf).drop("position"), path)
    header = spark.read.schema("provider string, total_questions bigint, successful bigint, failed bigint").json(f"{path}/header")
    rows = spark.read.schema(schemas.RESPONSE_ROW).json(f"{path}/responses")
    saved = rows.groupBy("provider").agg(F.count("response").alias("saved_responses"))
    return header.join(saved, "provider")


@query("snk_10_batch_results", o.over(_LINES_CTE + "SELECT 'openai' AS provider, strategy, question_id, response, total_tokens FROM lines WHERE status_code = 200"))
def _(spark, sf):
    path = scratch_path(spark, "batch-results")
    rows = readers.batch_responses(readers.parse_batch_lines(_batch_lines(spark, sf)), data.questions(spark, sf))
    writers.write_results(rows, path, 0)
    return spark.read.parquet(path).select("provider", "strategy", "question_id", "response", "total_tokens")


@query("snk_13_question_list", o.over("SELECT question_id, question, count(*) OVER () AS total_questions FROM questions"))
def _(spark, sf):
    path = scratch_path(spark, "question-list")
    writers.write_question_list(data.questions(spark, sf), path)
    header = spark.read.schema("total_questions bigint, timestamp string").json(f"{path}/header")
    return readers.read_question_list(spark, path).withColumn("total_questions", header.select("total_questions").scalar())

"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as contract
from gradeloom.catalog import data
from gradeloom.operators import facts, merge, quality
from gradeloom.plans.report import response_facts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory, small_dir):
    """Responses and questions as stored tables, read the way a cluster would."""
    path = str(tmp_path_factory.mktemp("tables"))
    data.responses(spark, small_dir).write.partitionBy("provider", "strategy").parquet(f"{path}/responses")
    data.questions(spark, small_dir).write.parquet(f"{path}/questions")
    return spark.read.parquet(f"{path}/responses"), spark.read.parquet(f"{path}/questions")



@pytest.fixture
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_columns(df):
    """Output columns of every shuffle in the plan."""
    node, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.nodeName() == "AdaptiveSparkPlan":
            walk(p.executedPlan())
            return
        if p.nodeName() == "Exchange":
            out = p.output()
            found.append({out.apply(i).name() for i in range(out.length())})
        kids = p.children()
        for i in range(kids.length()):
            walk(kids.apply(i))

    walk(node)
    return found


def test_response_text_is_not_shuffled_for_the_funnel(saved, no_auto_broadcast):
    responses, questions = saved
    shuffles = shuffled_columns(quality.funnel(response_facts(responses, questions.select("question_id", "answer"))))
    assert shuffles and all("response" not in s and "question" not in s and "_body" not in s for s in shuffles)


def test_question_outcomes_read_no_text(saved):
    responses, _ = saved
    text = plan(merge.question_outcomes(responses, ["openai", "gemini"], "position"))
    assert "response:string" not in text and "question:string" not in text


def test_group_selection_prunes_partitions(saved):
    text = plan(merge.select_work(saved[0], "gemini", "roberta"))
    assert "PartitionFilters: [isnotnull(provider" in text and "PushedFilters: []" in text and "Filter (" not in text


def test_low_token_filter_is_pushed_down(saved):
    text = plan(quality.low_token_responses(saved[0]).select("question_id"))
    assert "response:string" not in text and "ReadSchema" in text


def test_first_rows_limit_groups_before_the_shuffle(saved):
    text = plan(quality.first_rows(quality.suspicious_responses(saved[0]), quality.GROUP, "question_idx"))
    assert text.count("WindowGroupLimit") == 2


def test_success_rates_shuffle_group_rows_only(saved):
    shuffles = shuffled_columns(quality.success_rates(saved[0]))
    assert len(shuffles) == 1 and "question_id" not in shuffles[0]


def test_text_work_is_not_repeated(saved):
    """Stripping, lower-casing and each pattern occur once in the classification plan."""
    text = plan(facts.classify(saved[0]).select("question_id", "answer", "stage", "issue"))
    assert text.count("lower(_body") <= 2 and text.count("trim(response") == 1


NO_CROSS = [n for n in contract.queries() if n.startswith(("agg_", "jon_", "win_", "set_", "flt_", "srt_"))]


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_cross_joins(spark, small_dir, name):
    text = plan(contract.queries()[name](spark, small_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_cost_quality_reads_the_texts_once(spark, small_dir):
    result = contract.queries()["jon_11_cost_quality"](spark, small_dir)
    assert result.inputFiles() == [] and result.count() == 9  # cost and accuracy come from the same counted rows

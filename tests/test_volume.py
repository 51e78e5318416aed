"""Bytes that queries leave in the shared folder, against the bytes of the texts they handle."""

import os

import pytest

import __spark_entry__ as contract
from gradeloom import session
from gradeloom.catalog import data
from gradeloom.operators import merge
from gradeloom.sinks import writers


@pytest.fixture
def left_behind(spark, tmp_path, small_dir, monkeypatch):
    """Bytes that running a query leaves in the shared folder, as a multiple of the bytes of all texts."""
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    texts = data.table(spark, small_dir, "documents").selectExpr("sum(octet_length(text))").first()[0]

    def run(name):
        contract.queries()[name](spark, small_dir).collect()
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names) / texts

    return run


#: Nine responses a question hold its text about 13 times.
@pytest.mark.parametrize("name, most", [("src_05_largest_run", 4), ("src_11_provider_files", 4), ("snk_09_provider_results", 4), ("snk_02_run_results", 6), ("src_04_results_documents", 8), ("snk_14_consolidated", 1), ("stm_02_result_ingest", 2), ("src_10_response_cache", 12), ("src_10_cache_lookup", 12), ("snk_08_cache_upsert", 24)])
def test_texts_are_written_compressed(left_behind, name, most):
    share = left_behind(name)
    assert 0.1 < share < most


@pytest.mark.parametrize("name", ["src_10_response_cache", "src_10_cache_lookup"])
def test_a_cache_takes_little_more_than_its_texts(left_behind, name):
    """Staged and merged rows; small files would else be mostly Bloom filters."""
    assert 0.1 < left_behind(name) < 4


def text_shuffles(df):
    """Shuffles of the plan that carry the responses."""
    nodes, found = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
        found += node.nodeName() == "Exchange" and "response#" in node.output().mkString(",")
    return found


@pytest.fixture
def plain_joins(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_rows_that_come_first_are_shuffled(spark, plain_joins, make_responses):
    rows = make_responses(*[{"question_id": k % 500, "response": f"r{k}", "position": k} for k in range(3000)])
    placed = merge._placed(rows, "position")
    winners = merge._winners(placed)
    likely = merge._likely_first(placed, winners)
    assert likely.join(winners, ["provider", "question_id", "position", "contents"]).count() == 500 and likely.count() < 700
    assert text_shuffles(merge.first_response(rows, "position")) == 1


def test_stored_lines_are_not_shuffled(spark, plain_joins, tmp_path):
    schema = "custom_id string, response string, arrived timestamp, batch_id long"
    spark.createDataFrame([(f"q{k % 50}", f"r{k}", None, k) for k in range(60)], schema).write.parquet(str(tmp_path / "s"))
    kept = merge.latest_rows(merge.named_rows(spark.read.parquet(str(tmp_path / "s"))), ["custom_id"], ["batch_id"])
    assert text_shuffles(kept) == 0
    assert {r.response for r in kept.collect()} == {f"r{k}" for k in range(10, 60)}


@pytest.mark.parametrize("name", ["src_10_response_cache", "src_10_cache_lookup"])
def test_cached_texts_are_not_shuffled(spark, plain_joins, tmp_path, small_dir, monkeypatch, name):
    """Of all plans that write, and of the result's, none moves a response."""
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    kind, found = type(spark.range(0)), []
    write = kind.write
    monkeypatch.setattr(kind, "write", property(lambda df: found.append(text_shuffles(df)) or write.fget(df)))
    result = contract.queries()[name](spark, small_dir)
    assert result.count() > 0
    assert len(found) > 3 and not any(found) and not text_shuffles(result)


def test_run_results_take_less_than_their_codec_alone(spark, tmp_path, small_dir):
    """Their texts are compressed beyond zstd's own level and over more than a megabyte at once."""
    rows = data.responses(spark, small_dir).coalesce(1)
    writers.write_results(rows, str(tmp_path / "run"), 1)
    rows.write.partitionBy("provider", "strategy").parquet(str(tmp_path / "plain"), compression="zstd")
    size = {k: sum(f.stat().st_size for f in (tmp_path / k).rglob("*.parquet")) for k in ("run", "plain")}
    assert size["run"] < 0.96 * size["plain"]
    saved = spark.read.parquet(str(tmp_path / "run")).select("question_id", "provider", "strategy", "question", "response")
    assert saved.exceptAll(rows.select(*saved.columns)).count() == 0 and saved.count() == rows.count()


@pytest.fixture
def fixed_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def wide_shuffles(df):
    """Shuffles of the plan that carry a question, a response or a whole row's text."""
    nodes, found = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
        found += node.nodeName() == "Exchange" and any(f"{name}#" in node.output().mkString(",") for name in ("question", "response", "body", "value"))
    return found


def test_documents_take_little_more_than_themselves(spark, fixed_plans, tmp_path, small_dir, monkeypatch):
    """No plan that writes or reads them shuffles a response, and beside the documents the texts are stored once more at most."""
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    kind, found = type(spark.range(0)), []
    write = kind.write
    monkeypatch.setattr(kind, "write", property(lambda df: found.append(wide_shuffles(df)) or write.fget(df)))
    result = contract.queries()["src_04_results_documents"](spark, small_dir)
    assert result.count() > 0
    assert len(found) >= 3 and not any(found) and not wide_shuffles(result)
    size = {k.name.rsplit("-", 1)[0]: sum(f.stat().st_size for f in k.rglob("*") if f.is_file()) for k in tmp_path.iterdir()}
    assert sum(size.values()) < 1.5 * size["results-documents"]

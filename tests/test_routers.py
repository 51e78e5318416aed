"""Routers: structure, label domain, persistence, fallbacks, cross-validation."""

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from gradeloom import fixed_values as fv
from gradeloom.catalog import data
from gradeloom.operators import perceptron, requests, routers, routing
from gradeloom.operators.ranking import stratified_folds


@pytest.fixture(scope="module")
def rows(spark):
    """Separable embeddings: the label shows in the first values."""
    raw = spark.range(200).select(
        F.col("id").alias("vec_id"),
        F.get(F.array(*[F.lit(t) for t in fv.TEMPLATES]), (F.col("id") % 5).cast("int")).alias("template"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == F.col("id") % 5, 2.0).otherwise(0.0) + F.col("id") % 7 / 50.0).alias("embedding"),
    )
    return routers.embedding_features(raw).cache()


def accuracy(model, rows):
    return routing.classifier_accuracy(routers.scored_pairs(routers.score(model, rows))).first().accuracy_pct


def test_each_router_learns_separable_labels(rows):
    assert accuracy(routers.train_logistic(rows, max_iter=50), rows) > 95
    assert accuracy(routers.train_forest(rows, trees=10, depth=5), rows) > 95
    assert accuracy(routers.train_mlp(rows, hidden=(12,), max_iter=80), rows) > 90


def test_absent_labels_do_not_shift_the_names(rows):
    some = rows.where(F.col("template").isin("standard", "technical", "verbose")).cache()
    for model in (routers.train_logistic(some, max_iter=50, labels=fv.TEMPLATES), routers.train_mlp(some, hidden=(12,), max_iter=80, labels=fv.TEMPLATES)):
        assert accuracy(model, some) > 90
        before = model.stages[0].getHandleInvalid()
        routers.score(model, some.drop("label_name")).count()
        assert model.stages[0].getHandleInvalid() == before


def test_alphabetical_labels(rows):
    assert routers._label_indexer().fit(rows).labels == ["executive", "minimal", "standard", "technical", "verbose"]


def test_reloaded_router_predicts_the_same(rows, tmp_path):
    model = routers.train_logistic(rows, max_iter=20)
    routers.save_router(model, str(tmp_path / "m"))
    again = routers.load_router(str(tmp_path / "m"))
    a = routers.score(model, rows).select("vec_id", "predicted")
    b = routers.score(again, rows.drop("label_name")).select("vec_id", "predicted")
    assert a.exceptAll(b).count() == 0


def test_confidence_and_untrained(rows):
    scored = routers.route(routers.train_logistic(rows, max_iter=20), rows).first()
    assert 0.2 <= scored.confidence <= 1 and scored.reasoning == f"MLP prediction with {scored.confidence:.3f} confidence"
    constant = routers.route(None, rows).select("predicted", "confidence", "reasoning").distinct().collect()
    assert [tuple(r) for r in constant] == [("verbose", 0.5, "Not trained")]


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "template string")
    assert {r.template: r.weight for r in routers.class_weights(df).collect()} == {"a": 0.666667, "b": 2.0}


def test_text_router_cross_validation(spark):
    words = F.get(F.array(F.lit("sum of numbers"), F.lit("the old king"), F.lit("market price")), (F.col("id") % 3).cast("int"))
    names = F.get(F.array(F.lit("minimal"), F.lit("standard"), F.lit("executive")), (F.col("id") % 3).cast("int"))
    rows = spark.range(90).select("id", F.concat(words, F.lit(" item"), F.col("id")).alias("question"), names.alias("label_name"))
    folded = stratified_folds(rows, "id", "label_name", k=3).cache()
    metrics = routers.cross_validate(folded, lambda part: routers.train_text(part, max_iter=10))
    assert metrics.count() == 3
    summary = routing.cv_summary(metrics).first()
    assert summary.cv_mean_accuracy > 0.95 and summary.total_time > 0


def test_words_are_counted_once(spark):
    words = F.get(F.array(F.lit("sum of numbers"), F.lit("the old king"), F.lit("market price")), (F.col("id") % 3).cast("int"))
    names = F.get(F.array(F.lit("minimal"), F.lit("standard"), F.lit("executive")), (F.col("id") % 3).cast("int"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    rows = spark.range(90).select("id", F.concat(words, F.lit(" item"), F.col("id")).alias("question"), names.alias("label_name"))
    model = routers.train_text(rows.withColumn("question", read.asNondeterministic()("question")), max_iter=10, labels=fv.TEMPLATES)
    assert seen.value == 90  # each text is cut once, not once for every pass of the training
    counted = routers.counted_words(rows).drop("question").cache()
    again = routers.train_text(counted, max_iter=10, labels=fv.TEMPLATES)
    a = routers.score(model, rows).select("id", "predicted", F.round("confidence", 9))
    b = routers.score(again, counted).select("id", "predicted", F.round("confidence", 9))
    assert a.exceptAll(b).count() == 0 and b.count() == 90


def test_fallback_templates(spark):
    df = spark.createDataFrame([(1, "minimal", None), (2, None, "technical")], "question_id bigint, simple_neural string, roberta string")
    live = requests.routed_templates(df, ["simple_neural", "roberta"], "standard").orderBy("question_id").collect()
    assert [tuple(r) for r in live] == [(1, "verbose", "minimal", "standard"), (2, "verbose", "standard", "technical")]


def test_embedding_rows_have_all_labels(spark, small_dir):
    assert {r.template for r in data.router_rows(spark, small_dir).select("template").distinct().collect()} == set(fv.TEMPLATES)


def test_rounds_stop_on_the_held_out_score(rows):
    model, scores = routers.train_mlp_rounds(rows, hidden=(12,), rounds=12, iterations=30, patience=2, labels=fv.TEMPLATES)
    best = max(scores)
    since = len(scores) - 1 - scores.index(best)
    assert len(scores) < 12 and since == 2 and accuracy(model, rows) > 90
    assert len(model.stages) == 4 and routers.score(model, rows.drop("label_name")).count() == 200


def test_perceptrons_iterate_over_one_part_per_core(rows, monkeypatch):
    parts, cores = [], rows.sparkSession.sparkContext.defaultParallelism
    fit = routers.MultilayerPerceptronClassifier.fit

    def counted(net, data):
        parts.append(data.rdd.getNumPartitions())
        return fit(net, data)

    monkeypatch.setattr(routers.MultilayerPerceptronClassifier, "fit", counted)
    few = rows.coalesce(2)
    routers.train_mlp(few, hidden=(4,), max_iter=2, labels=fv.TEMPLATES)
    routers.train_mlp_rounds(few, hidden=(4,), rounds=1, iterations=2, labels=fv.TEMPLATES)
    assert parts == [cores, cores]


def test_decay_has_its_closed_form(rows):
    weights = DenseVector([1.0, -2.0, 0.5])
    now = weights
    for _ in range(7):
        now = routers.decayed(now, 0.1)
    assert np.allclose(now.toArray(), weights.toArray() * 0.9**7)
    # Rounds without iterations leave the decayed weights, so they shrink by the same factor in a real net.
    small = routers.train_mlp_rounds(rows, hidden=(4,), rounds=2, iterations=1, alpha=0.0, patience=5)[0].stages[2].weights.toArray()
    decayed = routers.train_mlp_rounds(rows, hidden=(4,), rounds=2, iterations=1, alpha=0.5, patience=5)[0].stages[2].weights.toArray()
    assert small.shape == decayed.shape and np.isfinite(decayed).all()


def test_lookup_router(spark):
    rows = spark.createDataFrame([("a'\\\\", "minimal")] * 3 + [("a'\\\\", "verbose")] + [("b", "verbose"), ("b", "standard"), (None, "verbose"), (None, "verbose")], "key string, label_name string")
    model = routers.train_lookup(rows, "key", fv.TEMPLATES)
    got = {r.key: (r.predicted, round(r.confidence, 3)) for r in routers.score(model, rows.drop("label_name").union(spark.createDataFrame([("new",)], "key string"))).collect()}
    assert got == {"a'\\\\": ("minimal", 0.75), "b": ("standard", 0.5), None: ("verbose", 0.5), "new": ("verbose", 0.5)}


def test_artefacts(spark, tmp_path):
    rows = spark.range(90).select("id", F.get(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3).cast("int")).alias("key"), F.get(F.array(F.lit("minimal"), F.lit("standard"), F.lit("verbose")), (F.col("id") % 3).cast("int")).alias("label_name"))
    path = str(tmp_path / "a")
    candidates = {"good": lambda part: routers.train_lookup(part, "key", fv.TEMPLATES), "bad": lambda part: routers.train_lookup(part.withColumn("key", F.lit("x")), "key", fv.TEMPLATES)}
    first = routers.train_artefact(rows, candidates, path, 1, "id")
    assert first.record["model"] == "good" and first.record["rows"] == 90 and first.record["mean_f1"] == 1
    assert first.metrics.count() == 6 and first.folds.groupBy("fold").count().count() == 3
    routers.train_artefact(rows, {"bad": candidates["bad"]}, path, 2, "id")
    spark.range(1).write.parquet(f"{path}/version=3/folds")  # not finished: no record
    last = routers.load_artefact(spark, path)
    assert last.record["version"] == 2 and routers.load_artefact(spark, path, 1).record["model"] == "good"
    a = routers.score(first.model, rows).select("id", "predicted")
    assert a.exceptAll(routers.score(routers.load_artefact(spark, path, 1).model, rows).select("id", "predicted")).count() == 0
    with pytest.raises(FileNotFoundError):
        routers.load_artefact(spark, path, 3)


def test_metric_files_hold_the_trained_routers(spark, small_dir):
    import __spark_entry__ as contract

    rows = {r.model: r for r in contract.queries()["snk_11_metric_files"](spark, small_dir).collect()}
    assert set(rows) == {"logistic", "forest", "by first character", "constant"}
    held = spark.read.parquet(f"{small_dir}/embeddings.parquet").where("vec_id % 5 = 0").count()
    assert rows["logistic"].questions == rows["forest"].questions == held
    assert rows["logistic"].accurate is not None and rows["constant"].accuracy is not None


def test_perceptron_gradient_is_that_of_its_loss(spark):
    layers, draw = [3, 4, 2], np.random.default_rng(1)
    x, y, weights = draw.normal(size=(20, 3)), draw.integers(0, 2, 20), perceptron.start([3, 4, 2], 1)
    total = np.zeros(len(weights))
    loss = perceptron.add_gradient(layers, weights, x, y, total)
    for k in range(len(weights)):
        moved = weights + 1e-5 * np.eye(len(weights))[k]
        assert abs((perceptron.add_gradient(layers, moved, x, y, np.zeros(len(weights))) - loss) / 1e-5 - total[k]) < 1e-3
    rows = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "values array<float>, label double").repartition(4)
    value, gradient = perceptron.objective(rows, layers)(weights)
    assert abs(value - loss / 20) < 1e-6 and np.allclose(gradient, total / 20, atol=1e-6)


def test_perceptron_weights_are_those_of_the_model(rows, monkeypatch):
    """Spark's model answers with the shares that the trained weights give, and its own trainer finds nothing much better."""
    kept = []
    monkeypatch.setattr(perceptron, "LEAST_ROWS", 0)
    found = perceptron.minimise
    monkeypatch.setattr(perceptron, "minimise", lambda *a, **b: kept.append(found(*a, **b)) or kept[-1])
    model = routers.train_mlp(rows, hidden=(6,), max_iter=60, labels=fv.TEMPLATES)
    assert np.allclose(model.stages[2].weights.toArray(), kept[0]) and model.stages[2].getMaxIter() == 60
    scaled = model.stages[1].transform(rows).select("features").collect()
    x = np.array([r[0].toArray() for r in scaled])
    z = perceptron._activations(perceptron._views([5, 6, 5], kept[0]), x)[-1]
    share = np.exp(z - z.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    got = np.array([r.confidence for r in routers.score(model, rows).select("confidence").collect()])
    assert np.allclose(got, share.max(axis=1), atol=1e-6)


def test_rounds_over_many_rows_stop_on_the_held_out_score(rows, monkeypatch):
    monkeypatch.setattr(perceptron, "LEAST_ROWS", 0)
    fits = []
    fit = routers.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(routers.MultilayerPerceptronClassifier, "fit", lambda net, data: fits.append(net.getMaxIter()) or fit(net, data))
    model, scores = routers.train_mlp_rounds(rows, hidden=(12,), rounds=6, iterations=30, patience=2, labels=fv.TEMPLATES)
    assert fits == [0] and accuracy(model, rows) > 90 and len(scores) <= 6
    assert scores.index(max(scores)) == len(scores) - 3 or len(scores) == 6


def test_minimise_finds_the_minimum_of_a_narrow_valley():
    def valley(w):
        a, b = w
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert np.allclose(perceptron.minimise(valley, np.array([-1.2, 1.0]), 200, 1e-12), [1, 1], atol=1e-3)
    assert perceptron.minimise(valley, np.array([-1.2, 1.0]), 0).tolist() == [-1.2, 1.0]

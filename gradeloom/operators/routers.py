"""Template routers as Spark ML pipelines: training, scoring, evaluation, persistence."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom import fixed_values as fv
from gradeloom.operators import perceptron
from gradeloom.operators.ranking import stratified_folds
from gradeloom.operators.routing import weighted_scores
from gradeloom.session import stored


def embedding_features(rows: DataFrame, embedding: str = "embedding", label: str = "template") -> DataFrame:
    """Rows with a dense vector column ``raw`` and the label name ``label_name``."""
    return rows.withColumn("raw", array_to_vector(F.col(embedding).cast("array<double>"))).withColumn(
        "label_name", F.col(label)
    )


def class_weights(rows: DataFrame, label: str = "template") -> DataFrame:
    """Balanced class weights n / (k * n_c), one row per class."""
    counted = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(1))  # over the classes, not the rows
    return counted.withColumn(
        "weight", F.round(F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")), 6)
    )


def _label_indexer() -> StringIndexer:
    return StringIndexer(inputCol="label_name", outputCol="label", stringOrderType="alphabetAsc")


def _labels(rows: DataFrame, labels: list[str] | None) -> list[str]:
    if labels is not None:
        return sorted(labels)
    return list(_label_indexer().fit(rows).labels)


#: Slots that the words of a question are hashed to.
WORD_SLOTS = 1 << 16


#: Megabytes of counts that are multiplied at once; every block costs one pass over slots times classes.
TEXT_BLOCK_MB = 16.0


def _word_counters(words: int) -> list:
    """Stages from the text to its hashed word counts; the column's name tells the number of slots."""
    return [
        RegexTokenizer(inputCol="question", outputCol="words", pattern=r"\W+"),
        HashingTF(inputCol="words", outputCol=f"tf_{words}", numFeatures=words),
    ]


def counted_words(rows: DataFrame, words: int = WORD_SLOTS) -> DataFrame:
    """Rows with the hashed word counts of their question.

    Store them without the text, and every training and scoring of a text router reads the counts instead of cutting the text again.
    """
    return PipelineModel(_word_counters(words)).transform(rows).drop("words")


def _fit(rows: DataFrame, classifier, scale: bool, labels: list[str], words: int | None = None) -> PipelineModel:
    """Indexer -> features -> classifier -> label name, fitted as one pipeline.

    One sorted list names the classes on both ends, whether or not each occurs in the rows. Rows
    with a label outside the list are an error.
    """
    stages = [StringIndexerModel.from_labels(labels, inputCol="label_name", outputCol="label", handleInvalid="error")]
    counters = _word_counters(words) if words else []
    if words:
        counts = counters[-1].getOutputCol()
        if counts not in rows.columns:
            rows = stored(counted_words(rows, words).select("label_name", counts), "word-counts")
        # every iteration sends one gradient a task, so there are as many tasks as cores, whatever the number of files
        rows = rows.select("label_name", counts).coalesce(rows.sparkSession.sparkContext.defaultParallelism)
        stages += [IDF(inputCol=counts, outputCol="features")]
    elif scale:
        stages += [StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]
    stages += [classifier, IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)]
    fitted = Pipeline(stages=stages).fit(rows)
    return PipelineModel([fitted.stages[0], *counters, *fitted.stages[1:]]) if words else fitted


def train_mlp(
    rows: DataFrame,
    hidden: tuple[int, ...] = (512, 256, 128),
    max_iter: int = 1000,
    seed: int = 42,
    labels: list[str] | None = None,
    width: int | None = None,
) -> PipelineModel:
    """Neural router on scaled embeddings."""
    names = _labels(rows, labels)
    size = width or rows.select(F.size("embedding")).first()[0]
    indexer = StringIndexerModel.from_labels(names, inputCol="label_name", outputCol="label", handleInvalid="error")
    marked = rows.select("label_name", "raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(marked)
    ready = stored(_trainable(_a_part_per_core(scaler.transform(indexer.transform(marked)).select("label", "features"))), "router-features")
    net = _net([size, *hidden, len(names)], max_iter, seed)
    naming = IndexToString(inputCol="prediction", outputCol="predicted", labels=names)
    if not perceptron.worth(ready):
        return PipelineModel([indexer, scaler, net.fit(ready), naming])
    weights = perceptron.minimise(perceptron.objective(ready.select("values", "label"), net.getLayers()), perceptron.start(net.getLayers(), seed), max_iter)
    return PipelineModel([indexer, scaler, _with_weights(net, weights, ready), naming])


def _net(layers: list[int], max_iter: int, seed: int) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=layers, maxIter=max_iter, seed=seed)


def _with_weights(net: MultilayerPerceptronClassifier, weights: np.ndarray, rows: DataFrame) -> MultilayerPerceptronClassificationModel:
    """Spark's model with the given weights: its own optimiser starts from them and evaluates them once over the rows."""
    model = net.copy().setInitialWeights(DenseVector(weights)).setMaxIter(0).fit(rows)
    model.set(model.maxIter, net.getMaxIter())
    return model


def _trainable(rows: DataFrame) -> DataFrame:
    """Rows with their features as floats, too, as ``perceptron`` reads them."""
    return rows.withColumn("values", vector_to_array("features", "float32"))


def _a_part_per_core(rows: DataFrame) -> DataFrame:
    """Rows in equal parts, one a core: every iteration waits for the last task, whatever files the rows come from."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def decayed(weights: DenseVector, alpha: float) -> DenseVector:
    """Weights after one round's decay: a share of ``alpha`` less."""
    return DenseVector(weights.toArray() * (1 - alpha))


def train_mlp_rounds(
    rows: DataFrame,
    hidden: tuple[int, ...] = (512, 256, 128),
    rounds: int = 20,
    iterations: int = 50,
    alpha: float = 0.01,
    patience: int = 3,
    least_gain: float = 1e-4,
    held_out: int = 5,
    seed: int = 42,
    labels: list[str] | None = None,
) -> tuple[PipelineModel, list[float]]:
    """Neural router that is trained in rounds, with early stopping and weight decay; also the held-out accuracy of every round.

    Spark's perceptron has neither. A round is a few iterations from the last round's weights
    after their decay. One row in ``held_out``, drawn by a hash of its embedding, is never fitted; training ends when the accuracy on those rows has
    not risen by ``least_gain`` for ``patience`` rounds, and the best round's weights stay.
    """
    names = _labels(rows, labels)
    indexer = StringIndexerModel.from_labels(names, inputCol="label_name", outputCol="label", handleInvalid="error")
    drawn = F.pmod(F.xxhash64("embedding", F.lit(seed)), F.lit(held_out)) == 0
    marked = stored(indexer.transform(rows.select("label_name", "raw", drawn.alias("held"))), "router-rows")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(marked.where("NOT held"))
    ready = stored(_trainable(_a_part_per_core(scaler.transform(marked).select("label", "features", "held"))), "router-features")
    fitted, held = ready.where("NOT held"), ready.where("held")
    size = fitted.select(F.size("values")).first()[0]
    net = _net([size, *hidden, len(names)], iterations, seed)
    layers = net.getLayers()
    evaluate = perceptron.objective(fitted.select("values", "label"), layers) if perceptron.worth(fitted) else None
    scores, best, last, model = [], None, None, None
    for _ in range(rounds):
        first = None if last is None else decayed(DenseVector(last), alpha)
        if evaluate:
            last = perceptron.minimise(evaluate, perceptron.start(layers, seed) if first is None else first.toArray(), iterations)
        else:
            model = (net if first is None else net.copy().setInitialWeights(first)).fit(fitted)
            last = model.weights.toArray()
        reached = perceptron.accuracy(held.select("values", "label"), layers, last)
        if best is None or reached >= max(scores) + least_gain:
            best, since = (last, model), 0
        else:
            since += 1
        scores.append(reached)
        if since >= patience:
            break
    naming = IndexToString(inputCol="prediction", outputCol="predicted", labels=names)
    weights, model = best
    return PipelineModel([indexer, scaler, model or _with_weights(net, weights, fitted), naming]), scores


#: Keys that a lookup router may have; they stand in its statement.
MOST_KEYS = 5000


def train_lookup(rows: DataFrame, key: str, labels: list[str] | None = None) -> PipelineModel:
    """Router that answers with the most frequent template of a row's key, of all rows for an unknown key; ties go to the first by name.

    The confidence is the template's share. It is the measure that other routers have to beat.
    """
    names = _labels(rows, labels)
    counted = rows.groupBy(F.col(key).cast("string").alias("k"), "label_name").agg(F.count(F.lit(1)).alias("n"))
    cells = stored(counted, "lookup")
    winner = F.max_by("label_name", F.struct("n", F.array_position(F.array(*[F.lit(x) for x in reversed(names)]), F.col("label_name"))))
    share = F.max("n") / F.sum("n")
    by_key = cells.where("k IS NOT NULL").groupBy("k").agg(winner.alias("t"), share.alias("share")).limit(MOST_KEYS + 1).collect()
    if len(by_key) > MOST_KEYS:
        raise ValueError(f"{key} has more than {MOST_KEYS} values")
    overall = cells.groupBy("label_name").agg(F.sum("n").alias("n")).agg(winner.alias("t"), share.alias("share")).first()

    def quoted(text: str | None) -> str:
        return "NULL" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def looked_up(values: list[str], kind: str, otherwise: str) -> str:
        pairs = ", ".join(f"{quoted(r.k)}, {v}" for r, v in zip(by_key, values))
        return f"coalesce({f'element_at(map({pairs}), CAST({key} AS STRING))' if pairs else f'CAST(NULL AS {kind})'}, {otherwise})"

    template = looked_up([quoted(r.t) for r in by_key], "STRING", quoted(overall.t))
    confidence = looked_up([f"CAST({r.share!r} AS DOUBLE)" for r in by_key], "DOUBLE", f"CAST({overall.share or 0.0!r} AS DOUBLE)")
    statement = f"SELECT *, {template} AS predicted, {confidence} AS confidence FROM __THIS__"
    indexer = StringIndexerModel.from_labels(names, inputCol="label_name", outputCol="label", handleInvalid="error")
    return PipelineModel([indexer, SQLTransformer(statement=statement)])


def train_logistic(rows: DataFrame, max_iter: int = 1000, c: float = 1.0, n_rows: int | None = None, labels: list[str] | None = None) -> PipelineModel:
    """Multinomial logistic router; the penalty c per sum becomes 1/(c*n) per mean."""
    names = _labels(rows, labels)
    n = n_rows or rows.count()
    model = LogisticRegression(
        featuresCol="features", labelCol="label", family="multinomial", maxIter=max_iter, regParam=1.0 / (c * max(n, 1))
    )
    return _fit(rows, model, True, names)


def train_forest(rows: DataFrame, trees: int = 100, depth: int = 10, min_leaf: int = 10, seed: int = 42, labels: list[str] | None = None) -> PipelineModel:
    """Random-forest router with balanced class weights."""
    names = _labels(rows, labels)
    weights = class_weights(rows, "label_name").select("label_name", "weight")
    weighted = rows.join(weights, "label_name")
    model = RandomForestClassifier(
        featuresCol="features",
        labelCol="label",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        weightCol="weight",
        seed=seed,
    )
    return _fit(weighted, model, True, names)


def train_text(
    rows: DataFrame, max_iter: int = 50, reg: float = 0.001, labels: list[str] | None = None, words: int = WORD_SLOTS
) -> PipelineModel:
    """Router on the question text: hashed word counts, inverse document frequency, logistic.

    ``words`` is the number of slots that words are hashed to. The text is read once; rows of ``counted_words`` need none.
    """
    names = _labels(rows, labels)
    model = LogisticRegression(
        featuresCol="features", labelCol="label", family="multinomial", maxIter=max_iter, regParam=reg, maxBlockSizeInMB=TEXT_BLOCK_MB
    )
    return _fit(rows, model, False, names, words)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``predicted`` (template name), ``confidence`` and ``reasoning``; rows of ``counted_words`` are not counted again."""
    scorable = rows if "label_name" in rows.columns else rows.withColumn("label_name", F.lit(None).cast("string"))
    indexer = model.stages[0].copy().setHandleInvalid("keep")
    counters = [s for s in model.stages if isinstance(s, (RegexTokenizer, HashingTF))]
    done = counters if counters and counters[-1].getOutputCol() in rows.columns else []
    scored = PipelineModel([indexer, *[s for s in model.stages[1:] if s not in done]]).transform(scorable)
    confidence = F.array_max(vector_to_array("probability")) if "probability" in scored.columns else F.col("confidence")
    return scored.withColumn("confidence", confidence).withColumn("reasoning", reasoning(confidence))


def reasoning(confidence: Column) -> Column:
    return F.format_string(fv.CONFIDENCE_REASONING, confidence)


def route(model: PipelineModel | None, rows: DataFrame, untrained: str = fv.BASELINE_TEMPLATE) -> DataFrame:
    """Template, confidence and reasoning per row; an untrained router answers with a constant."""
    if model is None:
        return rows.withColumn("predicted", F.lit(untrained)).withColumn("confidence", F.lit(0.5)).withColumn(
            "reasoning", F.lit(fv.UNTRAINED_REASONING)
        )
    return score(model, rows)


def scored_pairs(scored: DataFrame, *keep: str) -> DataFrame:
    return scored.select(*keep, F.col("label_name").alias("ground_truth"), "predicted")


def evaluate_models(models: dict[str, PipelineModel], rows: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Predictions of several models as (model, ground_truth, predicted) and the seconds each took."""
    seconds, parts = {}, []
    for name, model in models.items():
        pairs = scored_pairs(score(model, rows)).withColumn("model", F.lit(name))
        start = time.time()
        pairs.write.format("noop").mode("overwrite").save()
        seconds[name] = time.time() - start
        parts.append(pairs)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged, seconds


def cross_validate(rows: DataFrame, train, k: int = 3) -> DataFrame:
    """Fit on k-1 folds and score the rest: one metrics row per fold.

    ``rows`` has a ``fold`` column; ``train`` maps training rows to a fitted model. The
    folds are independent models, each trained by Spark over the whole training part.
    """
    metrics = []
    for fold in range(k):
        fit_rows, held_out = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        start = time.time()
        model = train(fit_rows)
        seconds = time.time() - start
        both = scored_pairs(score(model, fit_rows)).withColumn("part", F.lit("train")).unionByName(
            scored_pairs(score(model, held_out)).withColumn("part", F.lit("val"))
        )
        scores = weighted_scores(both, ["part"])
        row = scores.groupBy().agg(
            F.max(F.when(F.col("part") == "train", F.col("accuracy"))).alias("train_accuracy"),
            F.max(F.when(F.col("part") == "val", F.col("accuracy"))).alias("val_accuracy"),
            F.max(F.when(F.col("part") == "val", F.col("f1"))).alias("val_f1"),
        )
        metrics.append(row.select(F.lit(fold + 1).alias("fold"), "*", F.lit(seconds).alias("train_time")))
    merged = metrics[0]
    for part in metrics[1:]:
        merged = merged.unionByName(part)
    return merged


def save_router(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_router(path: str) -> PipelineModel:
    return PipelineModel.load(path)


@dataclass
class Artefact:
    """A trained router with the folds, metrics and record it was chosen by."""

    model: PipelineModel
    folds: DataFrame
    metrics: DataFrame
    record: dict


_RECORD = "version bigint, model string, k int, rows bigint, mean_accuracy double, mean_f1 double, trained_at string, train_time double"


def train_artefact(rows: DataFrame, candidates: dict, path: str, version: int, row_id: str, k: int = 3, seed: int = 42) -> Artefact:
    """Cross-validate several routers on the same folds, fit the best by mean F1 on all rows, and keep everything under one version.

    ``candidates`` maps names to functions from rows with ``label_name`` to a model. The record is written last: a version without it was not
    finished, and training it again overwrites it.
    """
    spark = rows.sparkSession
    target = f"{path}/version={version}"
    folded = stored(stratified_folds(rows, row_id, "label_name", k, seed), "folded")
    folded.select(row_id, "fold").write.mode("overwrite").parquet(f"{target}/folds")
    parts = [cross_validate(folded, train, k).withColumn("model", F.lit(name)) for name, train in candidates.items()]
    reduce(DataFrame.unionByName, parts).coalesce(1).write.mode("overwrite").parquet(f"{target}/metrics")
    means = spark.read.parquet(f"{target}/metrics").groupBy("model").agg(F.avg("val_f1").alias("f1"), F.avg("val_accuracy").alias("accuracy"))
    best = means.orderBy(F.col("f1").desc(), "model").first()
    start = time.time()
    model = candidates[best["model"]](folded.drop("fold"))
    save_router(model, f"{target}/model")
    record = (version, best["model"], k, folded.count(), best["accuracy"], best["f1"], datetime.now(timezone.utc).isoformat(), time.time() - start)
    spark.createDataFrame([record], _RECORD).coalesce(1).write.mode("overwrite").json(f"{path}/records/{version}")
    return load_artefact(spark, path, version)


def load_artefact(spark: SparkSession, path: str, version: int | None = None) -> Artefact:
    """One version, or the last finished one."""
    known = spark.read.schema(_RECORD).json(f"{path}/records/*")
    row = (known if version is None else known.where(F.col("version") == version)).orderBy(F.col("version").desc()).first()
    if row is None:
        raise FileNotFoundError(f"no finished version {version if version is not None else ''} in {path}")
    target = f"{path}/version={row['version']}"
    return Artefact(load_router(f"{target}/model"), spark.read.parquet(f"{target}/folds"), spark.read.parquet(f"{target}/metrics"), row.asDict())

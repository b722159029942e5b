"""Incident-type and severity classifiers."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from leakscan.operators.boosting import BoostedModel, BoostParams, fit_boosted
from leakscan.operators.metrics import accuracy, class_report, confusion, macro_scores
from leakscan.operators.sampling import class_weights, stratified_split, with_weight
from leakscan.plans.features import FeatureConfig, FeatureExtractor, FeatureModel, read_texts
from leakscan.session import materialise

DEFAULT_TARGETS = {"incident_type": "incident_type", "severity": "severity"}
PREDICTED = {"incident_type": "predicted_incident_type", "severity": "predicted_severity"}
CONFIDENCE = {"incident_type": "confidence_type", "severity": "confidence_severity"}
PARTS = ("features", "incident_type", "severity", "metrics")


@dataclass(frozen=True)
class TreeParams:
    """Settings shared by both models: a forest, or boosted trees, of which ``trees`` rounds grow one tree per class each."""

    trees: int = 40
    depth: int = 8
    max_bins: int = 32
    subset: str = "auto"
    seed: int = 42
    kind: str = "forest"
    rate: float = 0.2
    penalty: float = 1.0

    @classmethod
    def boosted(cls, trees: int = 30, depth: int = 3, **others) -> TreeParams:
        return cls(trees=trees, depth=depth, kind="boosted", **others)


#: Rows of a partition in training, which holds them with a draw per tree; rows from which the two models are fitted in turn.
TRAINED_ROWS, FITTED_IN_TURN = 100_000, 2_000_000

Classifier = PipelineModel | BoostedModel


@dataclass
class LeakModel:
    """Fitted features, both classifiers and the metrics of training."""

    features: FeatureModel
    incident_type: Classifier
    severity: Classifier
    metrics: dict[str, float] = field(default_factory=dict)
    params: TreeParams = field(default_factory=TreeParams)

    def classifier(self, target: str) -> Classifier:
        return {"incident_type": self.incident_type, "severity": self.severity}[target]


def check_targets(df: DataFrame, targets: dict[str, str] | None) -> dict[str, str]:
    targets = {**DEFAULT_TARGETS, **(targets or {})}
    for column in targets.values():
        if column not in df.columns:
            raise ValueError(f"target column {column!r} not found")
    return targets


def _fit_classifier(df: DataFrame, target: str, column: str, params: TreeParams, weight: str | None) -> Classifier:
    if params.kind == "boosted":
        settings = BoostParams(params.trees, params.depth, params.max_bins, params.rate, params.penalty)
        return fit_boosted(df, column, settings, weight)
    index, prediction = f"{target}_index", f"{target}_prediction"
    indexer = StringIndexer(inputCol=column, outputCol=index, stringOrderType="alphabetAsc").fit(df)
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol=index,
        predictionCol=prediction,
        probabilityCol=f"{target}_probability",
        rawPredictionCol=f"{target}_raw",
        numTrees=params.trees,
        maxDepth=params.depth,
        maxBins=params.max_bins,
        featureSubsetStrategy=params.subset,
        seed=params.seed,
    )
    if weight:
        forest = forest.setWeightCol(weight)
    model = forest.fit(indexer.transform(df))
    names = IndexToString(inputCol=prediction, outputCol=PREDICTED[target], labels=indexer.labels)
    return PipelineModel([model, names])


def train_type(features: DataFrame, column: str = "incident_type", params: TreeParams = TreeParams()) -> Classifier:
    """Unweighted incident-type model over a ``features`` column."""
    return _fit_classifier(features, "incident_type", column, params, None)


def train_severity(features: DataFrame, column: str = "severity", params: TreeParams = TreeParams()) -> Classifier:
    """Severity model with balanced class weights over a ``features`` column."""
    weighted = with_weight(features, column, class_weights(features, column), into="class_weight")
    return _fit_classifier(weighted, "severity", column, params, "class_weight")


def split(
    df: DataFrame, key: str, targets: dict[str, str] | None = None, test_fraction: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, stratified by incident type; the same rows for the same key and seed."""
    targets = check_targets(df, targets)
    marked = stratified_split(df, targets["incident_type"], key, test_fraction, seed)
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter(F.col("is_test")).drop("is_test")


def bounded_parts(prepared: DataFrame, rows: DataFrame, most: int | None = None) -> DataFrame:
    """``prepared`` in so many partitions that none holds much more than ``most`` of its rows; as it is where none does.

    ``rows`` is the table that it is made of, row by row, and cheaper to count. A table of few large files, or one that was dealt to
    the cores, has as many partitions however large it grows, and the trees read all of a partition in one task.
    """
    parts = rows.select(F.spark_partition_id().alias("part")).groupBy("part").count().agg(F.sum("count"), F.max("count")).first()
    most = most or TRAINED_ROWS
    if (parts[1] or 0) <= 2 * most:
        return prepared
    return prepared.repartition(-(-parts[0] // most))


def train(
    df: DataFrame,
    key: str,
    targets: dict[str, str] | None = None,
    config: FeatureConfig | None = None,
    params: TreeParams = TreeParams(),
    test_fraction: float = 0.2,
    seed: int = 42,
) -> LeakModel:
    """Stratified split, feature fit on the training part, both models, accuracy on the held-out part."""
    targets = check_targets(df, targets)
    marked = stratified_split(df, targets["incident_type"], key, test_fraction, seed)
    # Every text is read once, into a narrow table: vocabulary and features come from that, and it goes before the trees grow.
    read = read_texts(marked, config or FeatureConfig(), (*targets.values(), "is_test")).persist(StorageLevel.MEMORY_AND_DISK)
    prepared = None
    try:
        training = read.filter(~F.col("is_test"))
        features = FeatureExtractor(config).fit(training)
        columns = list(dict.fromkeys(targets.values()))
        prepared = bounded_parts(features.transform(read).select(*columns, "is_test", "features"), training)
        prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
        train_size = prepared.filter(~F.col("is_test")).count()
        read.unpersist()
        return _fit(prepared, train_size, features, targets, params)
    finally:
        read.unpersist()
        if prepared is not None:
            prepared.unpersist()


def _fit(prepared: DataFrame, train_size: int, features: FeatureModel, targets: dict[str, str], params: TreeParams) -> LeakModel:
    """Both models of the training rows of persisted features, and their accuracy on the rows that ``is_test`` holds out."""
    training = prepared.filter(~F.col("is_test")).drop("is_test")
    # The two fits share the persisted features and nothing else: side by side, unless their rows would crowd out each other's.
    run = inheritable_thread_target(prepared.sparkSession)
    with ThreadPoolExecutor(2 if train_size < FITTED_IN_TURN else 1) as pool:
        kind = pool.submit(run(train_type), training, targets["incident_type"], params)
        level = pool.submit(run(train_severity), training, targets["severity"], params)
        model = LeakModel(features, kind.result(), level.result(), params=params)

    scored = _predict(prepared.filter("is_test"), model)
    hits = {t: F.avg(F.col(PREDICTED[t]).eqNullSafe(F.col(c)).cast("double")).alias(t) for t, c in targets.items()}
    row = scored.agg(F.count(F.lit(1)).alias("n"), *hits.values()).first()
    model.metrics = {
        "incident_type_accuracy": row["incident_type"],
        "severity_accuracy": row["severity"],
        "train_size": float(train_size),
        "test_size": float(row["n"]),
        "n_features": float(len(features.feature_names)),
    }
    return model


def train_metrics(spark: SparkSession, model: LeakModel) -> DataFrame:
    """``(metric, value)`` of training."""
    return spark.createDataFrame([(k, float(v)) for k, v in model.metrics.items()], "metric string, value double")


def _apply(classifier: Classifier, df: DataFrame, target: str) -> DataFrame:
    if isinstance(classifier, BoostedModel):
        return classifier.transform(df, target, PREDICTED[target])
    return classifier.transform(df)


def log_loss(df: DataFrame, model: LeakModel, targets: dict[str, str] | None = None) -> dict[str, float]:
    """Mean negative log probability that each model gives to the true class; a class not learnt counts as 1e-15."""
    targets = check_targets(df, targets)
    out = model.features.transform(df)
    losses = []
    for target, actual in targets.items():
        classifier = model.classifier(target)
        labels = classifier.labels if isinstance(classifier, BoostedModel) else classifier.stages[1].getLabels()
        out = _apply(classifier, out, target)
        at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(actual)).cast("int") - 1
        p = F.get(vector_to_array(f"{target}_probability"), F.when(at >= 0, at))
        losses.append(F.avg(-F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(1e-15)))).alias(target))
    return out.agg(*losses).first().asDict()


def score(df: DataFrame, model: LeakModel, keep_pii: str | None = None) -> DataFrame:
    """Adds predicted class and confidence (largest class probability) of both targets; features are built once."""
    return _predict(model.features.transform(df, keep_pii=keep_pii), model)


def _predict(df: DataFrame, model: LeakModel) -> DataFrame:
    """Adds classes and confidences to a table of features, which go."""
    out = df
    for target in DEFAULT_TARGETS:
        out = _apply(model.classifier(target), out, target)
        confidence = F.array_max(vector_to_array(f"{target}_probability"))
        out = out.withColumn(CONFIDENCE[target], confidence)
        out = out.drop(f"{target}_prediction", f"{target}_probability", f"{target}_raw")
    return out.drop("features")


def importance(spark: SparkSession, model: LeakModel, target: str) -> DataFrame:
    """``(feature, importance)`` with importances that sum to 100."""
    classifier = model.classifier(target)
    boosted = isinstance(classifier, BoostedModel)
    values = classifier.importances() if boosted else classifier.stages[0].featureImportances.toArray()
    pairs = [(n, float(v) * 100.0) for n, v in zip(model.features.feature_names, values)]
    return spark.createDataFrame(pairs, "feature string, importance double")


def top_importance(spark: SparkSession, model: LeakModel, target: str, n: int = 20) -> DataFrame:
    return importance(spark, model, target).orderBy(F.desc("importance"), "feature").limit(n)


def model_info(spark: SparkSession, model: LeakModel) -> DataFrame:
    """``(kind, name, value)``: training metrics, number of features and model parameters."""
    rows = [("metric", k, str(v)) for k, v in model.metrics.items()]
    rows.append(("features", "n_features", str(len(model.features.feature_names))))
    for target in DEFAULT_TARGETS:
        classifier = model.classifier(target)
        if isinstance(classifier, BoostedModel):
            rows += [(target, name, str(v)) for name, v in asdict(classifier.params).items()]
        else:
            rows += [(target, p.name, str(v)) for p, v in classifier.stages[0].extractParamMap().items()]
    return spark.createDataFrame(rows, "kind string, name string, value string")


def evaluate(
    spark: SparkSession, model: LeakModel, df: DataFrame, targets: dict[str, str] | None = None
) -> dict[str, dict[str, DataFrame]]:
    """Per target: accuracy, macro scores, confusion matrix, class report and importances. Pass held-out rows.

    The rows are scored once into a narrow table of classes that all metrics read.
    """
    targets = check_targets(df, targets)
    columns = [*dict.fromkeys(targets.values()), *PREDICTED.values()]
    scored = materialise(score(df, model).select(*columns), "evaluated")
    tables = {}
    for target, actual in targets.items():
        predicted = PREDICTED[target]
        tables[target] = {
            "accuracy": accuracy(scored, actual, predicted),
            "macro": macro_scores(scored, actual, predicted),
            "confusion": confusion(scored, actual, predicted),
            "report": class_report(scored, actual, predicted),
            "importance": top_importance(spark, model, target),
        }
    return tables


def save_model(spark: SparkSession, model: LeakModel, path: str) -> None:
    """Writes features, both classifiers and metrics below one folder."""
    model.features.save(f"{path}/features", spark)
    for target in DEFAULT_TARGETS:
        classifier = model.classifier(target)
        if isinstance(classifier, BoostedModel):
            classifier.save(spark, f"{path}/{target}")
        else:
            classifier.write().overwrite().save(f"{path}/{target}")
    info = json.dumps({"metrics": model.metrics, "params": asdict(model.params)})
    spark.createDataFrame([(info,)], "info string").write.mode("overwrite").parquet(f"{path}/metrics")


def load_model(spark: SparkSession, path: str) -> LeakModel:
    """Restores a saved model; a folder with parts missing is rejected by name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    absent = [p for p in PARTS if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, p))]
    if absent:
        raise ValueError(f"model {path} lacks: {', '.join(absent)}")
    info = json.loads(spark.read.parquet(f"{path}/metrics").first()["info"])
    params = TreeParams(**info["params"])
    if params.kind == "boosted":
        kinds = [BoostedModel.load(spark, f"{path}/{t}") for t in DEFAULT_TARGETS]
    else:
        kinds = [PipelineModel.load(f"{path}/{t}") for t in DEFAULT_TARGETS]
    return LeakModel(FeatureModel.load(spark, f"{path}/features"), *kinds, info["metrics"], params)

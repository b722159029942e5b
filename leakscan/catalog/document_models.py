"""Models trained and evaluated on the given documents and labels.

Probabilities have no SQL; what must hold of them does. Each query gives named facts, and its SQL the values they must have.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.catalog.tables import documents, labelled
from leakscan.operators.boosting import BoostParams, fit_boosted
from leakscan.operators.sampling import stratified_split
from leakscan.plans import models as M
from leakscan.plans.features import FeatureConfig, FeatureExtractor
from leakscan.session import materialise, work_path

KEY, TERMS = "doc_id", 60
TARGETS = {"incident_type": "lang", "severity": "severity"}
CONFIG = FeatureConfig(
    text_col="text", category_col="source", timestamp_col=None, external_col=None, contains_col=None, rules="extended", max_terms=TERMS
)
FOREST, BOOSTED = M.TreeParams(trees=12, depth=5), BoostParams(rounds=12, depth=2, rate=0.4)


def _facts(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in rows], "fact string, value long")


def document_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both targets on documents with labels: training, scoring, evaluation, importance, information, saving and loading."""
    docs = materialise(documents(spark, sf_dir).join(labelled(spark, sf_dir), KEY).repartition(KEY), "labelled-documents")
    model = M.train(docs, KEY, TARGETS, CONFIG, FOREST)
    columns = [KEY, *M.PREDICTED.values(), *M.CONFIDENCE.values()]
    scored = materialise(M.score(docs, model).select(*columns, "lang"), "scored-documents")
    path = work_path(spark, "model")
    M.save_model(spark, model, path)
    again = M.score(docs, M.load_model(spark, path)).select(columns)
    kind, level = M.CONFIDENCE.values()
    told = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(kind).between(0, 1) & F.col(level).between(0, 1)).alias("in_range"),
        F.count_if(F.col(M.PREDICTED["severity"]).isin("Low", "Medium", "High", "Critical")).alias("severities"),
        F.avg(F.col(M.PREDICTED["incident_type"]).eqNullSafe(F.col("lang")).cast("double")).alias("right"),
    ).first()
    _, held_out = M.split(docs, KEY, TARGETS)
    reports = M.evaluate(spark, model, held_out, TARGETS)
    support = [reports[t]["confusion"].agg(F.sum("n")).first()[0] for t in TARGETS]
    shares = [M.importance(spark, model, t).agg(F.sum("importance")).first()[0] for t in TARGETS]
    info = {(r["kind"], r["name"]) for r in M.model_info(spark, model).collect()}
    metrics = {r["metric"]: r["value"] for r in M.train_metrics(spark, model).collect()}
    return _facts(
        spark,
        [
            ("rows scored", told["n"]),
            ("rows of the split", metrics["train_size"] + metrics["test_size"]),
            ("confidences from 0 to 1", told["in_range"]),
            ("predicted severities known", told["severities"]),
            ("rows equal after loading", scored.select(columns).intersectAll(again).count()),
            ("features", len(model.features.feature_names)),
            ("languages of nine in ten told", told["right"] >= 0.9),
            ("held-out rows in both confusion tables", set(support) == {metrics["test_size"]}),
            ("importances add up to 100", all(abs(s - 100) < 1e-6 for s in shares)),
            ("information names features and parameters", {("features", "n_features"), ("severity", "numTrees")} <= info),
            ("most important features", min(M.top_importance(spark, model, t, 20).count() for t in TARGETS)),
        ],
    )


def boosted_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees and a forest for the language of documents, compared on held-out rows."""
    docs = materialise(stratified_split(documents(spark, sf_dir).filter("lang IS NOT NULL"), "lang", KEY, 0.2), "split-documents")
    extractor = FeatureExtractor(CONFIG)
    extractor.fit(docs.filter(~F.col("is_test")))
    ready = materialise(extractor.transform(docs).select(KEY, "lang", "is_test", "features"), "document-features")
    training, held_out = ready.filter(~F.col("is_test")), ready.filter(F.col("is_test"))
    boosted = fit_boosted(training, "lang", BOOSTED)
    forest = M.train_type(training, "lang", FOREST)
    scored = materialise(boosted.transform(ready, "lang", "predicted"), "boosted")

    def loss(df: DataFrame, probability: str, labels: list[str]) -> float:
        at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("lang")).cast("int") - 1
        return df.agg(F.avg(-F.log(F.greatest(F.get(vector_to_array(probability), at), F.lit(1e-15))))).first()[0]

    p = vector_to_array("lang_probability")
    told = scored.agg(
        F.count_if(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("whole"),
        F.count_if(F.forall(p, lambda x: (x >= 0) & (x <= 1))).alias("in_range"),
        F.count_if(F.col("is_test")).alias("held_out"),
        F.avg(F.when(F.col("is_test"), (F.col("lang") == F.col("predicted")).cast("double"))).alias("right"),
    ).first()
    own = loss(scored.filter(F.col("is_test")), "lang_probability", boosted.labels)
    other = loss(forest.transform(held_out), "incident_type_probability", forest.stages[1].getLabels())
    return _facts(
        spark,
        [
            ("rows whose probabilities add up to 1", told["whole"]),
            ("rows whose probabilities lie from 0 to 1", told["in_range"]),
            ("classes", len(boosted.labels)),
            ("log loss of held-out rows below the forest's", own < other),
            ("held-out rows of nine in ten right", told["right"] >= 0.9),
            ("importances add up to 1", abs(boosted.importances().sum() - 1) < 1e-9),
        ],
    )


QUERIES = {"document_model": document_model, "boosted_language": boosted_language}

_LABELLED = "FROM documents JOIN labels USING (doc_id)"
ORACLES = {
    "document_model": " UNION ALL ".join(
        [f"SELECT '{fact}' AS fact, count(*)::BIGINT AS value {_LABELLED}" for fact in (
            "rows scored", "rows of the split", "confidences from 0 to 1", "predicted severities known", "rows equal after loading")]
        + [f"SELECT '{fact}', {value}::BIGINT" for fact, value in (
            ("features", 7 + TERMS + 1), ("languages of nine in ten told", 1), ("held-out rows in both confusion tables", 1),
            ("importances add up to 100", 1), ("information names features and parameters", 1), ("most important features", 20))]
    ),
    "boosted_language": " UNION ALL ".join(
        [f"SELECT '{fact}' AS fact, count(*)::BIGINT AS value FROM documents WHERE lang IS NOT NULL" for fact in (
            "rows whose probabilities add up to 1", "rows whose probabilities lie from 0 to 1")]
        + ["SELECT 'classes', count(DISTINCT lang)::BIGINT FROM documents"]
        + [f"SELECT '{fact}', 1::BIGINT" for fact in (
            "log loss of held-out rows below the forest''s", "held-out rows of nine in ten right", "importances add up to 1")]
    ),
}

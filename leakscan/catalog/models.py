"""Training, scoring and evaluation on synthetic incidents, and the streaming jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.catalog.pii import ORACLES as PII_ORACLES
from leakscan.catalog.pii import outcomes
from leakscan.catalog.synthesis import incidents as make_incidents
from leakscan.catalog.tables import joined, requests
from leakscan.functions.records import preview
from leakscan.plans import models as M
from leakscan.plans.features import FeatureConfig
from leakscan.plans.scoring import score_file, score_incidents
from leakscan.session import compiled, materialise, work_path
from leakscan.sources.files import read_csv, write_csv, write_parquet
from leakscan.streaming.score import read_output, scan_stream, scan_stream_with_rejects, score_stream

KEY = "o_orderkey"
# One incident table and one trained model per session and data folder: several queries look at the same ones.
_INCIDENTS: dict[tuple[str, str], DataFrame] = {}
_TRAINED: dict[tuple[str, str], M.LeakModel] = {}


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incident table derived from the orders, written once: training reads it many times."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INCIDENTS:
        with compiled(spark):
            _INCIDENTS[at] = materialise(make_incidents(spark, sf_dir), "incidents")
    return _INCIDENTS[at]


def _model(spark: SparkSession, sf_dir: str) -> M.LeakModel:
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _TRAINED:
        _TRAINED[at] = M.train(incidents(spark, sf_dir), KEY, config=FeatureConfig(max_terms=50))
    return _TRAINED[at]


def train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted classes and confidences of all incidents."""
    scored = M.score(incidents(spark, sf_dir), _model(spark, sf_dir))
    return scored.select(KEY, "incident_type", "severity", *M.PREDICTED.values(), *M.CONFIDENCE.values())


def train_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.train_metrics(spark, _model(spark, sf_dir))


def evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class reports of both targets over the held-out rows."""
    _, held_out = M.split(incidents(spark, sf_dir), KEY)
    tables = M.evaluate(spark, _model(spark, sf_dir), held_out)
    reports = [parts["report"].withColumn("target", F.lit(target)) for target, parts in tables.items()]
    return reduce(DataFrame.unionByName, reports)


def top_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir)
    tops = [M.top_importance(spark, model, t).withColumn("target", F.lit(t)) for t in M.DEFAULT_TARGETS]
    return reduce(DataFrame.unionByName, tops)


def model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.model_info(spark, _model(spark, sf_dir))


def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the model after it was saved and loaded."""
    path = work_path(spark, "model")
    M.save_model(spark, _model(spark, sf_dir), path)
    scored = M.score(incidents(spark, sf_dir), M.load_model(spark, path))
    return scored.select(KEY, *M.PREDICTED.values(), *M.CONFIDENCE.values())


def score_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = work_path(spark, "in") + ".csv", work_path(spark, "out") + ".csv"
    table = incidents(spark, sf_dir)
    write_csv(table, source)
    score_file(spark, source, target, _model(spark, sf_dir), table.schema)
    out = read_csv(spark, target)
    return out.select(KEY, "incident_type", "severity", *M.PREDICTED.values())


def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response records of all valid requests."""
    scored = score_incidents(requests(spark, sf_dir), _model(spark, sf_dir))
    return scored.select(
        "doc_id", *M.PREDICTED.values(), *M.CONFIDENCE.values(), "risk_level", "detected_pii", "pii_count", "recommendation"
    )


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as a stream over files that have arrived in a folder; a batch takes as many as there are cores, four at least."""
    folder = work_path(spark, "arrivals")
    table = requests(spark, sf_dir)
    write_parquet(table, folder)
    files = max(4, spark.sparkContext.defaultParallelism)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(folder)


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model-free scan as a streaming job."""
    target = work_path(spark, "scanned")
    scan_stream(_arriving(spark, sf_dir), target, work_path(spark, "checkpoint"))
    return spark.read.parquet(target).select(
        "doc_id",
        "department",
        "is_external_recipient",
        "risk_level",
        joined(F.col("detected_pii")).alias("detected_pii"),
        F.col("pii_count").cast("long").alias("pii_count"),
        "recommendation",
        preview(F.col("body")).alias("preview"),
    )


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outputs of the scan as a streaming job."""
    target, rejects = work_path(spark, "scanned"), work_path(spark, "rejected")
    scan_stream_with_rejects(_arriving(spark, sf_dir), target, rejects, work_path(spark, "checkpoint"))
    return outcomes(read_output(spark, target), read_output(spark, rejects))


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scoring as a streaming job."""
    target = work_path(spark, "scored")
    score_stream(_arriving(spark, sf_dir), _model(spark, sf_dir), target, work_path(spark, "checkpoint"))
    return spark.read.parquet(target).select("doc_id", *M.PREDICTED.values(), *M.CONFIDENCE.values(), "recommendation")


QUERIES = {
    "train_score": train_score,
    "train_metrics": train_metrics,
    "evaluate_model": evaluate_model,
    "top_importance": top_importance,
    "model_info": model_info,
    "model_roundtrip": model_roundtrip,
    "score_csv": score_csv,
    "score_requests": score_requests,
    "stream_scan": stream_scan,
    "stream_rejects": stream_rejects,
    "stream_score": stream_score,
}

ORACLES = {"stream_scan": PII_ORACLES["recommend"], "stream_rejects": PII_ORACLES["reject_records"]}

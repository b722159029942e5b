"""Scoring of request records: validation, description, features, classes, findings, advice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions.detect import detected_types
from leakscan.functions.records import COMPANY_DOMAIN, compose_text, default_department, is_external, recommendation
from leakscan.operators.findings import with_pii
from leakscan.operators.records import validate
from leakscan.plans.models import CONFIDENCE, PREDICTED, LeakModel, score
from leakscan.sources.files import read_csv, write_csv


def prepare(df: DataFrame, domain: str = COMPANY_DOMAIN) -> DataFrame:
    """Valid request records with the columns the models read."""
    valid, _ = validate(df)
    return (
        valid.withColumn("description", compose_text(F.col("subject"), F.col("body")))
        .withColumn("department", default_department(F.col("department")))
        .withColumn("is_external_recipient", is_external(F.col("recipient_email"), domain))
    )


def with_advice(df: DataFrame, incident_type: str, severity: str, pii: str = "pii") -> DataFrame:
    """Adds risk level, detected types, PII count and recommendation from a severity and a detection column."""
    d = F.col(pii)
    return (
        df.withColumn("risk_level", F.col(severity))
        .withColumn("detected_pii", detected_types(d))
        .withColumn("pii_count", d["pii_count"])
        .withColumn(
            "recommendation",
            recommendation(F.col(incident_type), F.col(severity), d["pii_count"], F.col("is_external_recipient")),
        )
    )


def score_incidents(df: DataFrame, model: LeakModel, domain: str = COMPANY_DOMAIN) -> DataFrame:
    """Response record of every valid request, in one lazy plan. Rejected records: see ``validate``."""
    scored = score(prepare(df, domain), model, keep_pii="pii")
    advised = with_advice(scored, PREDICTED["incident_type"], PREDICTED["severity"])
    return advised.drop("pii", "description")


def scan_messages(df: DataFrame, domain: str = COMPANY_DOMAIN, rules: str = "base") -> DataFrame:
    """Advice without a model: every record is an e-mail and its severity is the risk level of its findings."""
    found = with_pii(prepare(df, domain), "description", rules)
    rated = found.withColumn("incident_type", F.lit("email")).withColumn("severity", F.col("pii.risk_level"))
    return with_advice(rated, "incident_type", "severity").drop("pii", "description")


def with_rejects(df: DataFrame, job: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both outputs of a job over request records: the responses, and the rejected records as they came with their reason.

    Together they have one row for each record. Both are lazy plans over ``df``, which is read once for each.
    """
    return job(df), validate(df)[1]


def score_file(spark: SparkSession, source: str, target: str, model: LeakModel, schema=None) -> None:
    """CSV of incidents in, the same rows with both predicted classes out."""
    incidents = read_csv(spark, source, schema)
    write_csv(score(incidents, model).drop(*CONFIDENCE.values()), target)

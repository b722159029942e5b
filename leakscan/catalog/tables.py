"""Access to the standard tables and the stand-ins derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions.detect import text_or_empty
from leakscan.operators.findings import with_pii
from leakscan.operators.parallel import spread

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, spread over the cores where the file is a single split: pattern work is CPU-bound."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def severity(quality: Column, toxic: Column) -> Column:
    """Four imbalanced classes out of the two label columns."""
    return (
        F.when((quality == 1) & (toxic == 0), "Low")
        .when((quality == 0) & (toxic == 0), "Medium")
        .when((quality == 1) & (toxic == 1), "High")
        .otherwise("Critical")
    )


SEVERITY_SQL = (
    "CASE WHEN quality = 1 AND toxic = 0 THEN 'Low' WHEN quality = 0 AND toxic = 0 THEN 'Medium' "
    "WHEN quality = 1 AND toxic = 1 THEN 'High' ELSE 'Critical' END"
)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the severity stand-in."""
    return table(spark, sf_dir, "labels").withColumn("severity", severity(F.col("quality"), F.col("toxic")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, severity, predicted)``: the true class and what a fixed rule over the text makes of it."""
    found = with_pii(documents(spark, sf_dir), "text", "extended")
    ruled = found.select(
        "doc_id",
        F.when(F.col("pii.risk_level") == "High", "High")
        .when(F.col("pii.has_pii"), "Medium")
        .when(F.length(text_or_empty("text")) > 4000, "Critical")
        .when(F.length(text_or_empty("text")) > 2000, "Medium")
        .otherwise("Low")
        .alias("predicted"),
    )
    return labelled(spark, sf_dir).select("doc_id", "severity").join(ruled, "doc_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as request records: the source is the sender and its department, the text is the body."""
    d = documents(spark, sf_dir)
    return d.select(
        "doc_id",
        F.concat("source", F.lit("@company.com")).alias("user_email"),
        F.when(F.col("lang") == "en", "client@example.com").otherwise("peer@company.com").alias("recipient_email"),
        F.concat("lang", F.lit(" / "), "source").alias("subject"),
        F.col("text").alias("body"),
        F.array(F.col("source")).alias("attachment_names"),
        F.array().cast("array<string>").alias("attachment_types"),
        F.array(F.col("n_chars")).alias("attachment_sizes"),
        F.lit("2024-01-15T14:30:00").alias("timestamp"),
        F.nullif("source", F.lit("src0")).alias("department"),
        F.lit(None).cast("string").alias("user_role"),
    )


REQUESTS_SQL = """
  SELECT doc_id, source || '@company.com' AS user_email,
         CASE WHEN lang = 'en' THEN 'client@example.com' ELSE 'peer@company.com' END AS recipient_email,
         lang || ' / ' || source AS subject, text AS body, '2024-01-15T14:30:00' AS timestamp,
         nullif(source, 'src0') AS department
  FROM documents"""


def joined(col: Column) -> Column:
    """An array of strings as one comparable string."""
    return F.array_join(col, "|")


def draw_sql(key: str, salt: str = "", seed: int = SEED) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '|{seed}|{salt}'), 1, 8))::BIGINT::DOUBLE / 4294967296)"

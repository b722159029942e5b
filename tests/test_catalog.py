"""Every registered query against its SQL, and the ones without SQL against what must hold of them."""

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["source", "risk_level", "n", "pii_count", "percent"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == []


def test_kmeans_covers_the_table(spark, sf_dir):
    total = QUERIES["kmeans"](spark, sf_dir).agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_models_over_tables(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    scored = QUERIES["train_score"](spark, sf_dir)
    row = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("confidence_type").alias("low"),
        F.max("confidence_severity").alias("high"),
        F.collect_set("predicted_severity").alias("levels"),
        F.collect_set("predicted_incident_type").alias("types"),
        F.avg((F.col("incident_type") == F.col("predicted_incident_type")).cast("double")).alias("accuracy"),
    ).first()
    assert row["n"] == orders
    assert 0 <= row["low"] and row["high"] <= 1
    assert set(row["levels"]) <= {"Low", "Medium", "High", "Critical"}
    assert set(row["types"]) <= {"email", "usb", "cloud", "printer"}
    assert row["accuracy"] > 0.99
    again = QUERIES["model_roundtrip"](spark, sf_dir)
    assert scored.select(again.columns).exceptAll(again).count() == 0
    from_csv = QUERIES["score_csv"](spark, sf_dir)
    assert from_csv.join(again, "o_orderkey").filter(
        from_csv.predicted_severity == again.predicted_severity
    ).count() == orders


def test_streamed_scores_equal_batch(spark, sf_dir):
    batch = QUERIES["score_requests"](spark, sf_dir)
    stream = QUERIES["stream_score"](spark, sf_dir)
    cols = ["doc_id", "predicted_incident_type", "predicted_severity", "recommendation"]
    assert batch.select(cols).exceptAll(stream.select(cols)).count() == 0
    assert batch.count() == stream.count()


@pytest.mark.parametrize("name", ["evaluate_model", "top_importance", "model_info", "train_metrics", "project_2d", "index_build"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_typos_keep_length_and_other_letters(spark, sf_dir):
    df = QUERIES["typos"](spark, sf_dir)
    changed = df.filter(F.col("description") != F.col("typed"))
    assert changed.count() > 0
    assert df.filter(F.length("description") != F.length("typed")).count() == 0
    mapped = "[аоеитпрлАОЕИТПРЛдД]"
    strip = lambda c: F.regexp_replace(c, mapped, "")
    assert df.filter(strip("description") != strip("typed")).count() == 0


def test_synthetic_tables(spark, sf_dir):
    for name in ("synth_incidents", "synth_enhanced"):
        df = QUERIES[name](spark, sf_dir)
        kinds = {r["incident_type"]: r["share"] for r in df.groupBy("incident_type").agg((F.count("*") / df.count()).alias("share")).collect()}
        wanted = (0.5, 0.2, 0.2, 0.1) if name == "synth_incidents" else (0.4, 0.25, 0.2, 0.15)
        for kind, share in zip(("email", "usb", "cloud", "printer"), wanted):
            assert abs(kinds[kind] - share) < 0.05
        assert df.filter(F.col("description").isNull() | F.col("severity").isNull()).count() == 0
        assert df.filter(F.col("description").rlike(r"\{\w+\}")).count() == 0
    enhanced = QUERIES["synth_enhanced"](spark, sf_dir)
    assert enhanced.filter((F.col("incident_type") == "printer") != F.col("timestamp").isNull()).count() == 0

"""Features, models, files and streams end to end on small tables; shape of the physical plans."""

import json

import pytest
from pyspark.sql import functions as F

from leakscan.operators.findings import with_pii
from leakscan.operators.records import REQUEST_SCHEMA
from leakscan.operators.synth import synth_incidents
from leakscan.plans.features import FeatureConfig, FeatureExtractor
from leakscan.plans.models import TreeParams, load_model, save_model, score, train
from leakscan.plans.scoring import score_incidents
from leakscan.plans.similarity import build_index, find_similar_text
from leakscan.session import work_path
from leakscan.sources.files import INCIDENT_SCHEMA, read_auto, read_csv, read_json, write_csv
from leakscan.sources.vectors import load_vectors
from leakscan.streaming.score import read_requests, score_stream


@pytest.fixture(scope="module")
def incidents(spark):
    return synth_incidents(spark, 600)


@pytest.fixture(scope="module")
def model(incidents):
    return train(incidents, "incident_id", config=FeatureConfig(max_terms=50), params=TreeParams(trees=10, depth=6))


def test_schema_of_synthetic_incidents(spark, incidents):
    assert [(f.name, f.dataType) for f in incidents.schema] == [(f.name, f.dataType) for f in INCIDENT_SCHEMA]


def test_feature_layout(spark, incidents):
    extractor = FeatureExtractor(FeatureConfig(max_terms=50))
    with pytest.raises(ValueError):
        extractor.transform(incidents)
    with pytest.raises(ValueError):
        extractor.feature_names
    out = extractor.fit_transform(incidents)
    names = extractor.feature_names
    assert len(names) == 64
    assert names[:2] == ["has_card", "has_passport"] and names[-2:] == ["is_external_recipient", "contains_pii"]
    widths = {len(r["features"]) for r in out.select("features").collect()}
    assert widths == {64}
    assert out.count() == incidents.count()


def test_features_of_unseen_and_missing(spark, incidents):
    fitted = FeatureExtractor(FeatureConfig(max_terms=20)).fit(incidents)
    odd = incidents.limit(3).withColumn("department", F.lit("Nowhere")).withColumn("timestamp", F.lit("broken")).drop("contains_pii")
    row = fitted.transform(odd).first()["features"]
    at = dict(zip(fitted.feature_names, row))
    assert (at["encoded_department"], at["hour_of_day"], at["day_of_week"]) == (-1, 12, 2)
    with pytest.raises(ValueError):
        fitted.transform(incidents.drop("description"))
    bare = FeatureConfig(category_col=None, timestamp_col=None, external_col=None, contains_col=None, use_pii=False, max_terms=20)
    assert FeatureExtractor(bare).fit(incidents).feature_names[0].startswith("tfidf_")


def test_body_as_text_column(spark):
    df = spark.createDataFrame([(f"2024-01-0{i} 10:00:00", "IT", f"общий текст письма {i}") for i in range(1, 6)], "timestamp string, department string, body string")
    config = FeatureConfig(text_col="body", external_col=None, contains_col=None, max_terms=10)
    assert FeatureExtractor(config).fit_transform(df).count() == 5


def test_training(model):
    assert model.metrics["incident_type_accuracy"] > 0.95
    assert model.metrics["train_size"] + model.metrics["test_size"] == 600
    assert model.metrics["n_features"] == 64


def test_training_needs_targets(incidents):
    with pytest.raises(ValueError):
        train(incidents.drop("severity"), "incident_id")


def test_save_and_load(spark, model, incidents):
    path = work_path(spark, "model")
    save_model(spark, model, path)
    cols = ["incident_id", "predicted_incident_type", "predicted_severity", "confidence_severity"]
    again = score(incidents, load_model(spark, path)).select(cols)
    assert score(incidents, model).select(cols).exceptAll(again).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        load_model(spark, work_path(spark, "nothing"))


def _requests():
    ok = {
        "user_email": "oleg@company.com",
        "recipient_email": "nina@partner.org",
        "subject": "Ledger extract for review",
        "body": "Pay from 4111 2222 3333 4444, passport 7301 654321. Call +7 912 555-01-02 or write to desk@partner.org",
        "attachment_names": ["ledger.csv", "scan.png"],
        "attachment_types": ["text/csv", "image/png"],
        "attachment_sizes": [1200, 98000],
        "timestamp": "2023-11-02T08:05:00",
        "department": "Finance",
    }
    return [ok, {**ok, "department": None, "recipient_email": "b@company.com", "body": "See the table below"}, {**ok, "body": ""}, {**ok, "attachment_sizes": "large"}]


def test_requests_from_json(spark, model, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(_requests()), encoding="utf-8")
    df = read_json(spark, str(tmp_path / "in.json"), REQUEST_SCHEMA)
    rows = score_incidents(df.filter(F.col("attachment_sizes").isNotNull()), model).collect()
    assert len(rows) == 2
    found = next(r for r in rows if r["department"] == "Finance")
    assert found["detected_pii"] == ["card", "passport", "phone", "email"] and found["pii_count"] == 4
    assert found["risk_level"] == found["predicted_severity"] and found["is_external_recipient"]
    assert 0 <= found["confidence_type"] <= 1
    assert next(r for r in rows if r["department"] == "Unknown")["pii_count"] == 0


def test_stream_of_request_files(spark, model, tmp_path):
    folder = tmp_path / "arrivals"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in _requests()), encoding="utf-8")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    score_stream(read_requests(spark, str(folder)), model, out, checkpoint)
    assert spark.read.parquet(out).count() == 2  # the empty body and the malformed record are rejected
    (folder / "b.json").write_text(json.dumps(_requests()[0]), encoding="utf-8")
    score_stream(read_requests(spark, str(folder)), model, out, checkpoint)
    assert spark.read.parquet(out).count() == 3


def test_files(spark, tmp_path):
    text = 'a "quoted" line\nand, another'
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string")
    path = str(tmp_path / "x.CSV")
    write_csv(df, path)
    assert [tuple(r) for r in read_auto(spark, path, schema=df.schema).orderBy("id").collect()] == [(1, text), (2, None), (3, None)]
    marked = tmp_path / "bom.csv"
    marked.write_bytes("﻿id,t\n1,привет\n".encode())
    assert read_csv(spark, str(marked)).columns == ["id", "t"]
    with pytest.raises(ValueError, match="supported"):
        read_auto(spark, "x.xlsx")


def test_similar_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "карта клиента отправлена"), (2, "печать договора"), (3, "карта клиента")], "id int, description string")
    top = find_similar_text(spark, df, "карта клиента", 2).orderBy("rank").collect()
    assert [r["id"] for r in top] == [3, 1] and top[0]["similarity"] == pytest.approx(1)
    build_index(df, "description", str(tmp_path / "index"))
    stored = load_vectors(spark, str(tmp_path / "index"), 384)
    assert find_similar_text(spark, stored, "печать договора", 1).first()["id"] == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir, model, incidents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scan = plan(with_pii(docs.filter("n_chars > 100"), "text").select("doc_id", "pii.risk_level"))
    assert "Exchange" not in scan and "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,100)]" in scan
    assert "lang" not in scan.split("ReadSchema")[1]
    scored = plan(score(incidents, model).select("incident_id", "predicted_severity"))
    assert "SortMergeJoin" not in scored and "BroadcastHashJoin" in scored
    assert "Python" not in scored

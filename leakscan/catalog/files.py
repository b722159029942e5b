"""Readers and writers: every table comes back as it was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakscan.catalog.tables import table
from leakscan.session import work_path
from leakscan.sources.files import read_auto, read_csv, read_json, read_parquet, write_csv, write_parquet


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = work_path(spark, "documents") + ".csv"
    write_csv(docs, path)
    return read_csv(spark, path, docs.schema)


def csv_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = work_path(spark, "orders") + ".CSV"
    write_csv(orders, path)
    return read_auto(spark, path, schema=orders.schema)


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    path = work_path(spark, "conversations")
    talks.write.json(path)
    return read_json(spark, path, talks.schema, lines=True)


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioned by class."""
    path = work_path(spark, "documents")
    write_parquet(table(spark, sf_dir, "documents"), path, "lang")
    return read_parquet(spark, path).select("doc_id", "lang", "source", "n_chars")


def typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_auto(spark, f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "csv_auto": csv_auto,
    "json_roundtrip": json_roundtrip,
    "parquet_roundtrip": parquet_roundtrip,
    "typed_scan": typed_scan,
}

ORACLES = {
    "csv_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "csv_auto": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "json_roundtrip": "SELECT conv_id, turn, role, text FROM conversations",
    "parquet_roundtrip": "SELECT doc_id, lang, source, n_chars FROM documents",
    "typed_scan": "SELECT p_partkey, p_brand, p_size FROM part",
}

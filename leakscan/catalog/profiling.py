"""Profiles, samples and group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.catalog.tables import SEED, SEVERITY_SQL, documents, draw_sql, labelled, table
from leakscan.functions.detect import RISK_LEVELS
from leakscan.functions.rules import rule_set
from leakscan.operators import profile
from leakscan.operators.findings import with_pii
from leakscan.operators.sampling import sample_n
from leakscan.session import materialise, work_path


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, null where there is none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = profile.table_info(table(spark, sf_dir, "lineitem"))
    return info.select("column_name", "missing", "n_rows", F.col("n_columns").cast("long").alias("n_columns"))


def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.missing(_reviewed(spark, sf_dir)), "percent")


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = profile.describe_numeric(table(spark, sf_dir, "lineitem"), cols)
    return _rounded(out, "mean", "std", "min", "max", "q25", "q50", "q75")


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.distribution(table(spark, sf_dir, "documents"), "lang"), "percent")


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.balance_flags(labelled(spark, sf_dir), "severity"), "percent")


def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.imbalance(labelled(spark, sf_dir), "severity"), "ratio")


def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.cardinality(table(spark, sf_dir, "events"), ["user_id", "event_type"])


_COUNTED = ["user_id", "event_type", "event_id"]
#: Three standard errors of a sketch of the default power.
_SKETCH_ERROR = 0.02


def cardinality_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values from stored sketches of two parts of events, against the exact counts.

    The second part's profile is added to the stored one; neither part is read to merge them.
    """
    events = table(spark, sf_dir, "events")
    path = work_path(spark, "distinct-sketches")
    for part in (F.hour("ts") < 12, (F.hour("ts") >= 12) | F.col("ts").isNull()):
        profile.distinct_sketches(events.filter(part), _COUNTED).write.mode("append").parquet(path)
    merged = profile.merged_cardinality(spark.read.parquet(path))
    exact = profile.cardinality(events, _COUNTED).withColumnRenamed("n_distinct", "exact")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.ceil(F.col("exact") * _SKETCH_ERROR)
    return merged.join(exact, "column_name").select("column_name", "n_rows", "n_missing", "exact", near.alias("near"))


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches per document by severity, classes in fixed order."""
    found = with_pii(documents(spark, sf_dir), "text", "extended").select("doc_id", F.col("pii.pii_count").alias("pii_count"))
    both = labelled(spark, sf_dir).select("doc_id", "severity").join(found, "doc_id").select("severity", "pii_count")
    both = materialise(both, "matches")  # three passes follow; the rules run once
    out = profile.group_stats(both, "severity", "pii_count", RISK_LEVELS)
    out = out.withColumns({"position": F.col("position").cast("long"), "max": F.col("max").cast("long")})
    return _rounded(out, "mean", "median")


def five_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.five_number(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return _rounded(out, "q1", "median", "q3", "whisker_low", "whisker_high")


def five_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewed lengths: most classes have outliers."""
    out = profile.five_number(table(spark, sf_dir, "documents"), "lang", "n_chars")
    return _rounded(out, "q1", "median", "q3", "whisker_low", "whisker_high")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_n(table(spark, sf_dir, "events"), 5000, "event_id", SEED).select("event_id", "event_type", "value")


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM lineitem"""


def _five_sql(source: str, by: str, v: str) -> str:
    return f"""WITH q AS (SELECT {by}, quantile_cont({v}::DOUBLE, 0.25) AS q1, quantile_cont({v}::DOUBLE, 0.5) AS median,
  quantile_cont({v}::DOUBLE, 0.75) AS q3 FROM {source} GROUP BY {by}),
j AS (SELECT {by}, {v}::DOUBLE AS v, q1, median, q3,
  {v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM {source} JOIN q USING ({by}))
SELECT {by}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(v) FILTER (inside), 6) AS whisker_low, round(max(v) FILTER (inside), 6) AS whisker_high,
  count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY {by}, j.q1, j.median, j.q3"""


_LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()
_LABELLED = f"(SELECT *, {SEVERITY_SQL} AS severity FROM labels)"

QUERIES = {
    "table_info": table_info,
    "missing_report": missing_report,
    "describe": describe,
    "distribution": distribution,
    "balance_flags": balance,
    "imbalance": imbalance,
    "cardinality": cardinality,
    "cardinality_merged": cardinality_merged,
    "group_stats": group_stats,
    "five_number": five_number,
    "five_number_text": five_number_text,
    "sample_n": sample,
}

ORACLES = {
    "table_info": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, count(*) AS n_rows, "
        f"{len(_LINEITEM)}::BIGINT AS n_columns FROM lineitem"
        for c in _LINEITEM
    ),
    "missing_report": "WITH r AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, "
        f"round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 6)::DOUBLE AS percent FROM r"
        for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")
    )
    + ") WHERE missing > 0",
    "describe": " UNION ALL ".join(_describe_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "distribution": """SELECT lang AS value, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM documents GROUP BY lang""",
    "balance_flags": f"""SELECT severity AS value, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS percent,
  count(*) * 100.0 / sum(count(*)) OVER () BETWEEN 20 AND 30 AS balanced FROM {_LABELLED} GROUP BY severity""",
    "imbalance": f"""SELECT max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 6)::DOUBLE AS ratio,
  max(n) / min(n) > 3 AS imbalanced FROM (SELECT count(*) AS n FROM {_LABELLED} GROUP BY severity)""",
    "cardinality": """SELECT 'user_id' AS column_name, count(DISTINCT user_id) AS n_distinct FROM events
UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events""",
    "cardinality_merged": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_missing, "
        f"count(DISTINCT {c}) AS exact, true AS near FROM events"
        for c in _COUNTED
    ),
    "group_stats": f"""WITH p AS (SELECT doc_id,
  {" + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}', 0))" for p in rule_set("extended").values())} AS pii_count
  FROM documents),
s AS (SELECT severity, pii_count FROM {_LABELLED} JOIN p USING (doc_id)),
o AS (SELECT unnest(['Low', 'Medium', 'High', 'Critical']) AS severity, unnest([0, 1, 2, 3])::BIGINT AS position)
SELECT o.severity, position, count(pii_count) AS n, round(avg(pii_count), 6) AS mean, round(median(pii_count), 6)::DOUBLE AS median,
  max(pii_count)::BIGINT AS max FROM o LEFT JOIN s USING (severity) GROUP BY o.severity, position""",
    "five_number": _five_sql("lineitem", "l_returnflag", "l_extendedprice"),
    "five_number_text": _five_sql("documents", "lang", "n_chars"),
    "sample_n": f"SELECT event_id, event_type, value FROM events ORDER BY {draw_sql('event_id')}, event_id LIMIT 5000",
}

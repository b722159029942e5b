"""Time, category and text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.catalog.tables import documents, table
from leakscan.functions.temporal import TEMPORAL_FEATURES, bool_feature, parse_ts, temporal_features
from leakscan.functions.text import normalise
from leakscan.operators.categories import apply_codes, fit_codes
from leakscan.operators.profile import hourly, weekday_counts
from leakscan.operators.vocabulary import TfIdf, fit_idf, fit_vocabulary

TERMS = 50


def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time features of events whose time is text, unreadable for errors."""
    events = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("ts").cast("string"))
    timed = events.select("event_id", parse_ts(raw).alias("ts"))
    out = timed.select("event_id", *temporal_features(F.col("ts")))
    return out.select("event_id", *[F.col(c).cast("long").alias(c) for c in TEMPORAL_FEATURES])


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0/1 flag of a comparison that is null for documents without a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("flag"))
    return docs.join(labels, "doc_id", "left").select("doc_id", bool_feature(F.col("flag")).cast("long").alias("flag"))


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(table(spark, sf_dir, "events"), "event_type", "ts").withColumn("hour", F.col("hour").cast("long"))


def weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = weekday_counts(table(spark, sf_dir, "events"), "event_type", "ts")
    return counts.withColumn("day_of_week", F.col("day_of_week").cast("long"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes fitted where one source has not been seen yet."""
    return fit_codes(table(spark, sf_dir, "documents").filter(F.col("source") != "src7"), "source")


def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).withColumn("code", F.col("code").cast("long"))


def category_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    coded = apply_codes(docs, "source", _codes(spark, sf_dir))
    return coded.withColumn("encoded_source", F.col("encoded_source").cast("long"))


def category_codes_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a key of many values, numbered in ranges: the driver takes none of them."""
    codes = fit_codes(table(spark, sf_dir, "orders"), "o_orderkey", max_local=100, per_range=2000)
    return codes.withColumn("code", F.col("code").cast("long"))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(normalise(F.col("text"))).alias("digest"))


def tokens_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_vocabulary(documents(spark, sf_dir), "text", TERMS, high=1)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_vocabulary(documents(spark, sf_dir), "text", TERMS)


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_idf(documents(spark, sf_dir), "text", TERMS).withColumn("idf", F.round("idf", 6))


def tfidf_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = TfIdf.fit(docs, "text", TERMS).long(docs, "doc_id", "text")
    return weights.withColumn("weight", F.round("weight", 6))


_TOKENS = "regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}_]{2,}', 0)"


def _vocabulary_sql(high: int) -> str:
    terms = "t" if high == 1 else "t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
    return f"""WITH w AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
e AS (SELECT doc_id, unnest({terms}) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY doc_id, term),
v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM c GROUP BY term HAVING count(*) >= 2
      ORDER BY tf DESC, term LIMIT {TERMS})"""


_IDF = "ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1"

QUERIES = {
    "temporal_features": temporal,
    "bool_features": flags,
    "hourly_counts": hourly_counts,
    "weekday_counts": weekdays,
    "category_codes": category_codes,
    "category_apply": category_apply,
    "category_codes_ranged": category_codes_ranged,
    "normalised_text": normalised,
    "tokens_top": tokens_top,
    "vocabulary": vocabulary,
    "idf": idf,
    "tfidf_long": tfidf_long,
}

_CODES = """c AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code
      FROM (SELECT DISTINCT coalesce(source, 'unknown') AS value FROM documents WHERE source <> 'src7'))"""

ORACLES = {
    "temporal_features": """WITH e AS (SELECT event_id,
  try_cast(CASE WHEN event_type = 'error' THEN props ELSE ts::VARCHAR END AS TIMESTAMP) AS t FROM events)
SELECT event_id, coalesce(hour(t), 12)::BIGINT AS hour_of_day,
       coalesce((hour(t) >= 22 OR hour(t) <= 6)::BIGINT, 0) AS is_night,
       coalesce(isodow(t) - 1, 2)::BIGINT AS day_of_week, coalesce((isodow(t) >= 6)::BIGINT, 0) AS is_weekend
FROM e""",
    "bool_features": """SELECT doc_id, coalesce((toxic = 1)::BIGINT, 0) AS flag
FROM documents LEFT JOIN labels USING (doc_id)""",
    "hourly_counts": "SELECT event_type, hour(ts)::BIGINT AS hour, count(*) AS n FROM events GROUP BY ALL",
    "weekday_counts": """SELECT event_type, (isodow(ts) - 1)::BIGINT AS day_of_week, count(*) AS n,
       substr(dayname(ts), 1, 3) AS day_name FROM events GROUP BY ALL""",
    "category_codes": f"WITH {_CODES} SELECT value, code::BIGINT AS code FROM c",
    "category_apply": f"""WITH {_CODES} SELECT doc_id, source, coalesce(code, -1)::BIGINT AS encoded_source
FROM documents LEFT JOIN c ON coalesce(source, 'unknown') = value""",
    "category_codes_ranged": """SELECT value, row_number() OVER (ORDER BY value) - 1 AS code
FROM (SELECT DISTINCT coalesce(o_orderkey::VARCHAR, 'unknown') AS value FROM orders)""",
    "normalised_text": "SELECT doc_id, md5(strip_accents(lower(coalesce(text, '')))) AS digest FROM documents",
    "tokens_top": f"{_vocabulary_sql(1)} SELECT term, df, tf FROM v",
    "vocabulary": f"{_vocabulary_sql(2)} SELECT term, df, tf FROM v",
    "idf": f"{_vocabulary_sql(2)} SELECT term, df, tf, round({_IDF}, 6) AS idf FROM v",
    "tfidf_long": f"""{_vocabulary_sql(2)}, x AS (SELECT doc_id, term, c.tf * ({_IDF}) AS raw FROM c JOIN v USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""",
}

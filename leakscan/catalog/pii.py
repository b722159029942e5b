"""Detection, records and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.catalog.tables import REQUESTS_SQL, documents, joined, requests, table
from leakscan.functions.detect import MATCH_FIELDS, detected_types, pii_features, pii_matches
from leakscan.functions.records import RECOMMENDATIONS, preview
from leakscan.functions.rules import BASE_RULES, rule_set
from leakscan.operators.findings import pii_findings, with_pii
from leakscan.operators.profile import pii_prevalence
from leakscan.operators.records import errors, head, select_like, where_class, with_reject_reason
from leakscan.operators.parallel import spread
from leakscan.plans.scoring import scan_messages, with_rejects


def _report(df: DataFrame, key: str) -> DataFrame:
    pii = F.col("pii")
    return df.select(
        key,
        *[joined(pii[f]).alias(f) for f in MATCH_FIELDS.values()],
        F.size(pii["persons"]).cast("long").alias("n_persons"),
        joined(detected_types(pii)).alias("types"),
        pii["has_pii"].alias("has_pii"),
        pii["pii_count"].cast("long").alias("pii_count"),
        pii["risk_level"].alias("risk_level"),
        pii["detection_method"].alias("detection_method"),
    )


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(with_pii(documents(spark, sf_dir), "text"), "doc_id")


def pii_scan_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(with_pii(documents(spark, sf_dir), "text", "extended"), "doc_id")


def pii_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(with_pii(spread(table(spark, sf_dir, "pages"), "page_id"), "html"), "page_id")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_findings(documents(spark, sf_dir), "doc_id", "text", "extended")
    return found.withColumn("pos", F.col("pos").cast("long"))


def phone_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = pii_matches("text", "phone", group=1)
    return documents(spark, sf_dir).select("doc_id", joined(prefixes).alias("prefixes")).filter(F.col("prefixes") != "")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = with_pii(documents(spark, sf_dir), "text", "extended").select("doc_id", *pii_features(F.col("pii")))
    return flags.select("doc_id", *[F.col(c).cast("long").alias(c) for c in flags.columns[1:]])


def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = pii_prevalence(with_pii(documents(spark, sf_dir), "text", "extended"))
    return row.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes])


def risk_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source and risk level with their share of the source."""
    found = with_pii(documents(spark, sf_dir), "text", "extended")
    counts = found.groupBy("source", F.col("pii.risk_level").alias("risk_level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("pii.pii_count").cast("long")).alias("pii_count")
    )
    totals = counts.groupBy("source").agg(F.sum("n").alias("total"))
    return counts.join(totals, "source").select(
        "source", "risk_level", "n", "pii_count", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent")
    )


def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_reject_reason(requests(spark, sf_dir)).select("doc_id", "reject_reason")


def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    advised = scan_messages(requests(spark, sf_dir))
    return advised.select(
        "doc_id",
        "department",
        "is_external_recipient",
        "risk_level",
        joined(F.col("detected_pii")).alias("detected_pii"),
        F.col("pii_count").cast("long").alias("pii_count"),
        "recommendation",
        preview(F.col("body")).alias("preview"),
    )


def outcomes(scored: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per record of either output: what came of it."""
    told = scored.select(
        "doc_id", F.lit("scored").alias("outcome"), F.lit(None).cast("string").alias("reject_reason"),
        "risk_level", F.col("pii_count").cast("long").alias("pii_count"), "recommendation",
    )
    return told.unionByName(
        rejected.select("doc_id", F.lit("rejected").alias("outcome"), "reject_reason"), allowMissingColumns=True
    )


def reject_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outputs of the scan: advice for valid requests, the reason for the others."""
    return outcomes(*with_rejects(requests(spark, sf_dir), scan_messages))


#: A caller's own rules beside two of the built-in ones; plain enough to mean the same in SQL's expressions.
CUSTOM_RULES = {
    "card": BASE_RULES["card"],
    "email": BASE_RULES["email"],
    "ip_address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "secret": r"(?:api_key|password|token)[=:] ?[A-Za-z0-9_-]{6,}",
    "licence": r"SPDX-License-Identifier: [A-Za-z0-9.-]+",
    "money": r"[$][0-9]+",
}


def pii_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a caller's rule map: built-in and further rules, one row per match."""
    found = pii_findings(documents(spark, sf_dir), "doc_id", "text", CUSTOM_RULES)
    return found.withColumn("pos", F.col("pos").cast("long"))


def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_like(table(spark, sf_dir, "lineitem"), numeric=True)


def columns_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_like(table(spark, sf_dir, "part"), "size", "name")


def class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = where_class(table(spark, sf_dir, "events"), event_type="error")
    return rows.select("event_id", "user_id", "value")


def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status differs from the status of one of their lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return errors(both, "o_orderstatus", "l_linestatus").select("l_orderkey", "l_linenumber", "o_orderstatus", "l_linestatus")


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 3, "o_orderkey")


def _matches_sql(source: str, key: str, text: str, rules: str) -> str:
    cols = ", ".join(
        f"regexp_extract_all(coalesce({text}, ''), '{p}', 0) AS {MATCH_FIELDS[r]}" for r, p in rule_set(rules).items()
    )
    return f"SELECT *, {cols} FROM {source}"


_COUNT = "(len(cards) + len(passports) + len(inn) + len(snils) + len(phones) + len(emails))"
_RISK = (
    "CASE WHEN len(passports) > 0 AND len(cards) > 0 THEN 'Critical' WHEN len(passports) > 0 OR len(cards) > 0 THEN 'High' "
    "WHEN (len(inn) > 0)::INT + (len(snils) > 0)::INT >= 2 THEN 'Medium' ELSE 'Low' END"
)
_TYPES = (
    "array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN len({f}) > 0 THEN '{r}' END" for r, f in MATCH_FIELDS.items())
    + "], lambda x: x IS NOT NULL), '|')"
)


def _report_sql(source: str, key: str, text: str, rules: str) -> str:
    joined_cols = ", ".join(f"array_to_string({f}, '|') AS {f}" for f in MATCH_FIELDS.values())
    return f"""WITH m AS ({_matches_sql(source, key, text, rules)})
SELECT {key}, {joined_cols}, 0::BIGINT AS n_persons, {_TYPES} AS types, {_COUNT} > 0 AS has_pii,
       {_COUNT}::BIGINT AS pii_count, {_RISK} AS risk_level, 'regex only' AS detection_method
FROM m"""


_M_EXT = f"WITH m AS ({_matches_sql('documents', 'doc_id', 'text', 'extended')})"
_FLAGS = ", ".join(f"(len({f}) > 0)::BIGINT AS has_{r}" for r, f in MATCH_FIELDS.items())
_REJECT = """CASE WHEN user_email IS NULL THEN 'user_email: missing' WHEN recipient_email IS NULL THEN 'recipient_email: missing'
  WHEN subject IS NULL THEN 'subject: missing' WHEN body IS NULL THEN 'body: missing'
  WHEN timestamp IS NULL THEN 'timestamp: missing'
  WHEN length(subject) < 1 THEN 'subject: too short' WHEN length(subject) > 500 THEN 'subject: too long'
  WHEN length(body) < 1 THEN 'body: too short' WHEN length(body) > 10000 THEN 'body: too long' END"""
_ADVICE = " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in RECOMMENDATIONS.items())

QUERIES = {
    "pii_scan": pii_scan,
    "pii_scan_extended": pii_scan_extended,
    "pii_scan_pages": pii_scan_pages,
    "pii_findings": findings,
    "phone_prefixes": phone_prefixes,
    "pii_features": features,
    "pii_prevalence": prevalence,
    "risk_by_source": risk_by_source,
    "validate_records": validate_records,
    "recommend": recommend,
    "reject_records": reject_records,
    "pii_custom": pii_custom,
    "numeric_columns": numeric_columns,
    "columns_like": columns_like,
    "class_rows": class_rows,
    "mismatches": mismatches,
    "head_rows": head_rows,
}

ORACLES = {
    "pii_scan": _report_sql("documents", "doc_id", "text", "base"),
    "pii_scan_extended": _report_sql("documents", "doc_id", "text", "extended"),
    "pii_scan_pages": _report_sql("pages", "page_id", "html", "base"),
    "pii_findings": _M_EXT
    + " UNION ALL ".join(
        f" SELECT doc_id, '{r}' AS pii_type, unnest({f}) AS match, "
        f"unnest(range(len({f})))::BIGINT AS pos FROM m"
        for r, f in MATCH_FIELDS.items()
    ),
    "phone_prefixes": f"""SELECT doc_id, array_to_string(regexp_extract_all(text, '{rule_set("base")["phone"]}', 1), '|') AS prefixes
FROM documents WHERE len(regexp_extract_all(text, '{rule_set("base")["phone"]}', 1)) > 0""",
    "pii_features": f"{_M_EXT} SELECT doc_id, {_FLAGS}, {_COUNT}::BIGINT AS pii_count FROM m",
    "pii_prevalence": f"""{_M_EXT}
SELECT count(*) AS n_rows, count(*) FILTER ({_COUNT} > 0) AS n_with_pii, round(avg({_COUNT}), 6) AS mean_pii,
       round(avg(({_COUNT} > 0)::INT), 6) AS share_with_pii,
       {", ".join(f"count(*) FILTER (len({f}) > 0) AS n_{r}" for r, f in MATCH_FIELDS.items())},
       {", ".join(f"round(avg((len({f}) > 0)::INT), 6) AS share_{r}" for r, f in MATCH_FIELDS.items())}
FROM m""",
    "risk_by_source": f"""{_M_EXT}, r AS (SELECT source, {_RISK} AS risk_level, {_COUNT} AS c FROM m)
SELECT source, risk_level, count(*) AS n, sum(c)::BIGINT AS pii_count,
       round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source), 6)::DOUBLE AS percent
FROM r GROUP BY source, risk_level""",
    "validate_records": f"WITH q AS ({REQUESTS_SQL}) SELECT doc_id, {_REJECT} AS reject_reason FROM q",
    "recommend": f"""WITH q AS ({REQUESTS_SQL}),
v AS (SELECT *, subject || '. ' || body AS description, NOT ends_with(recipient_email, '@company.com') AS ext
      FROM q WHERE {_REJECT} IS NULL),
m AS ({_matches_sql("v", "doc_id", "description", "base")}),
r AS (SELECT *, {_RISK} AS risk, {_COUNT}::BIGINT AS n FROM m)
SELECT doc_id, coalesce(nullif(department, ''), 'Unknown') AS department, ext AS is_external_recipient, risk AS risk_level,
       {_TYPES} AS detected_pii, n AS pii_count,
       concat_ws('. ', CASE risk {_ADVICE} ELSE 'Проверить инцидент' END,
                 CASE WHEN n > 0 THEN 'Обнаружено ' || n || ' PII' END,
                 CASE WHEN ext THEN 'Отправка внешнему получателю - повышенный риск' END,
                 CASE WHEN risk IN ('High', 'Critical') THEN 'Рекомендуется проверить получателя и содержимое вложений' END)
       || CASE WHEN n > 0 OR ext OR risk IN ('High', 'Critical') THEN '.' ELSE '' END AS recommendation,
       substring(body, 1, 100) AS preview
FROM r""",
    "numeric_columns": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem""",
    "columns_like": "SELECT p_name, p_size FROM part",
    "class_rows": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error'",
    "mismatches": """SELECT l_orderkey, l_linenumber, o_orderstatus, l_linestatus
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IS DISTINCT FROM l_linestatus""",
    "head_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3",
}

_OUTCOMES = f"""WITH a AS ({ORACLES["recommend"]}), q AS ({REQUESTS_SQL})
SELECT doc_id, 'scored' AS outcome, NULL::VARCHAR AS reject_reason, risk_level, pii_count, recommendation FROM a
UNION ALL SELECT doc_id, 'rejected', {_REJECT}, NULL, NULL, NULL FROM q WHERE {_REJECT} IS NOT NULL"""
ORACLES["reject_records"] = _OUTCOMES
ORACLES["pii_custom"] = "WITH m AS (SELECT doc_id, " + ", ".join(
    f"regexp_extract_all(coalesce(text, ''), '{p}', 0) AS {r}" for r, p in CUSTOM_RULES.items()
) + " FROM documents)" + " UNION ALL ".join(
    f" SELECT doc_id, '{r}' AS pii_type, unnest({r}) AS match, unnest(range(len({r})))::BIGINT AS pos FROM m" for r in CUSTOM_RULES
)

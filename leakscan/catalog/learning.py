"""Splits, class weights and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.catalog.tables import SEED, SEVERITY_SQL, draw_sql, labelled, predictions, table
from leakscan.functions.detect import RISK_LEVELS
from leakscan.functions.rules import rule_set
from leakscan.operators import metrics, sampling


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _on_predictions(operator, **kwargs):
    """Query that runs a metric over the rule's predictions."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(operator(predictions(spark, sf_dir), "severity", "predicted", **kwargs))

    return query


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.stratified_split(docs, "lang", "doc_id", 0.2, SEED)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sampling.class_weights(labelled(spark, sf_dir), "severity"))


def weighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sampling.with_weight(labelled(spark, sf_dir), "severity").select("doc_id", "severity", "weight"))


_PRED = f"""d AS (SELECT doc_id, text, len(regexp_extract_all(coalesce(text, ''), '{rule_set("extended")["card"]}', 0)) > 0
    OR len(regexp_extract_all(coalesce(text, ''), '{rule_set("extended")["passport"]}', 0)) > 0 AS high,
  {" + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}', 0))" for p in rule_set("extended").values())} > 0 AS pii
  FROM documents),
p AS (SELECT doc_id, {SEVERITY_SQL} AS severity,
  CASE WHEN high THEN 'High' WHEN pii THEN 'Medium' WHEN length(coalesce(text, '')) > 4000 THEN 'Critical'
       WHEN length(coalesce(text, '')) > 2000 THEN 'Medium' ELSE 'Low' END AS predicted
  FROM labels JOIN d USING (doc_id))"""
_CLASSES = f"""{_PRED},
k AS (SELECT DISTINCT c AS class FROM (SELECT severity AS c FROM p UNION ALL SELECT predicted FROM p)),
s AS (SELECT class, count(*) FILTER (severity = class) AS true_count, count(*) FILTER (predicted = class) AS predicted_count,
  count(*) FILTER (severity = class AND predicted = class) AS correct_count FROM k CROSS JOIN p GROUP BY class),
m AS (SELECT *, CASE WHEN predicted_count = 0 THEN 0.0::DOUBLE ELSE correct_count::DOUBLE / predicted_count END AS precision,
  CASE WHEN true_count = 0 THEN 0.0::DOUBLE ELSE correct_count::DOUBLE / true_count END AS recall FROM s),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)"""

QUERIES = {
    "stratified_split": split,
    "class_weights": weights,
    "weighted_rows": weighted_rows,
    "accuracy": _on_predictions(metrics.accuracy),
    "confusion": _on_predictions(metrics.confusion),
    "confusion_labels": _on_predictions(metrics.confusion, labels=RISK_LEVELS),
    "macro_scores": _on_predictions(metrics.macro_scores),
    "class_report": _on_predictions(metrics.class_report),
    "per_class": _on_predictions(metrics.per_class),
    "error_pairs": _on_predictions(metrics.error_pairs),
}

ORACLES = {
    "stratified_split": f"""SELECT doc_id, lang,
  row_number() OVER (PARTITION BY lang ORDER BY {draw_sql('doc_id')}, doc_id) <= round(count(*) OVER (PARTITION BY lang) * 0.2)
  AS is_test FROM documents""",
    "class_weights": f"""WITH c AS (SELECT {SEVERITY_SQL} AS class, count(*) AS n FROM labels GROUP BY ALL)
SELECT class, n, round(sum(n) OVER () / (count(*) OVER () * n), 6)::DOUBLE AS weight FROM c""",
    "weighted_rows": f"""WITH l AS (SELECT doc_id, {SEVERITY_SQL} AS severity FROM labels),
c AS (SELECT severity, count(*) AS n FROM l GROUP BY ALL),
w AS (SELECT severity, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c)
SELECT doc_id, severity, round(weight, 6)::DOUBLE AS weight FROM l JOIN w USING (severity)""",
    "accuracy": f"WITH {_PRED} SELECT round(avg((severity = predicted)::INT), 6) AS accuracy FROM p",
    "confusion": f"""WITH {_CLASSES}
SELECT a.class AS actual, b.class AS predicted, count(p.doc_id) AS n FROM k a CROSS JOIN k b
LEFT JOIN p ON p.severity = a.class AND p.predicted = b.class GROUP BY ALL""",
    "confusion_labels": f"""WITH {_PRED}, k AS (SELECT unnest(['Low', 'Medium', 'High', 'Critical']) AS class)
SELECT a.class AS actual, b.class AS predicted, count(p.doc_id) AS n FROM k a CROSS JOIN k b
LEFT JOIN p ON p.severity = a.class AND p.predicted = b.class GROUP BY ALL""",
    "macro_scores": f"""WITH {_CLASSES} SELECT round((SELECT avg((severity = predicted)::INT) FROM p), 6) AS accuracy,
  round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro FROM f""",
    "class_report": f"""WITH {_CLASSES}, n AS (SELECT sum(true_count)::BIGINT AS n FROM f),
r AS (SELECT class AS label, precision, recall, f1, true_count AS support FROM f
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT avg((severity = predicted)::INT) AS a FROM p), n
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), max(n) FROM f, n
  UNION ALL SELECT 'weighted avg', sum(precision * true_count) / max(n), sum(recall * true_count) / max(n),
    sum(f1 * true_count) / max(n), max(n) FROM f, n)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r""",
    "per_class": f"""WITH {_CLASSES} SELECT class, true_count, predicted_count, correct_count, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, recall > 0.6 AS recognised FROM f""",
    "error_pairs": f"""WITH {_PRED}, e AS (SELECT severity AS actual, predicted, count(*) AS n FROM p
  WHERE severity <> predicted GROUP BY ALL)
SELECT actual, predicted, n, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM e ORDER BY n DESC, actual, predicted LIMIT 5""",
}

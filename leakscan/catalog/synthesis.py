"""Synthetic incidents, one per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.catalog.tables import SEED, documents, draw_sql, joined, table
from leakscan.functions.detect import MATCH_FIELDS
from leakscan.operators import synth
from leakscan.operators.findings import with_pii
from leakscan.operators.parallel import spread


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def incidents(spark: SparkSession, sf_dir: str, enhanced: bool = False) -> DataFrame:
    return synth.synth_over(_keys(spark, sf_dir), "o_orderkey", SEED, enhanced)


def synth_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = synth.pii_payload(F.col("o_orderkey"), SEED)
    return _keys(spark, sf_dir).select("o_orderkey", *[c.alias(n) for n, c in payload.items()])


def synth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("incident_type", "severity", "is_external_recipient", "department", "file_name", "cloud_service", "document_type")
    return incidents(spark, sf_dir).select("o_orderkey", *cols)


def synth_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the plain variant with what the base rules find in them."""
    found = with_pii(incidents(spark, sf_dir), "description")
    pii = F.col("pii")
    return found.select(
        "o_orderkey",
        "incident_id",
        "description",
        *[joined(pii[f]).alias(f) for f in MATCH_FIELDS.values()],
        pii["risk_level"].alias("risk_level"),
    )


def synth_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _keys(spark, sf_dir).select(
        key,
        synth.recent_ts(key, SEED).cast("string").alias("recent"),
        synth.synth_ts(key, SEED).cast("string").alias("working"),
    )


def synth_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir)


def synth_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir, enhanced=True)


def typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typing errors over the plain texts; length and unmapped letters never change."""
    texts = incidents(spark, sf_dir).select("o_orderkey", "description")
    return texts.withColumn("typed", synth.add_typos(F.col("description"), F.col("o_orderkey"), 0.02, SEED))


def _pick(salt: str, values: list[str]) -> str:
    """SQL element of a list by draw."""
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{items}][floor({draw_sql('o_orderkey', salt)} * {len(values)})::INT + 1]"


def _int(salt: str, low: int, high: int) -> str:
    return f"(floor({draw_sql('o_orderkey', salt)} * {high - low + 1}) + {low})::BIGINT"


def _dig(salt: str, n: int) -> str:
    return f"lpad(floor({draw_sql('o_orderkey', salt)} * {10**n})::BIGINT::VARCHAR, {n}, '0')"


_PAYLOAD = f"""'Person-' || {_dig('name', 8)} AS name, '+79' || {_dig('phone0', 4)} || {_dig('phone1', 5)} AS phone,
  {" || ' ' || ".join(_int(f'card{i}', 1000, 9999) for i in range(4))} AS card,
  {_int('passport0', 1000, 9999)} || ' ' || {_int('passport1', 100000, 999999)} AS passport,
  {" || ".join(_dig(f'inn{i}', 4) for i in range(3))} AS inn,
  {" || '-' || ".join(_int(f'snils{i}', 100, 999) for i in range(3))} || ' ' || {_int('snils3', 10, 99)} AS snils"""
_U_TYPE = draw_sql("o_orderkey", "type")
_KIND = f"""k AS (SELECT o_orderkey, CASE WHEN {_U_TYPE} < 0.5 THEN 'email' WHEN {_U_TYPE} < 0.7 THEN 'usb'
    WHEN {_U_TYPE} < 0.9 THEN 'cloud' ELSE 'printer' END AS incident_type,
  {draw_sql('o_orderkey', 'external')} < 0.7 AS ext, floor({draw_sql('o_orderkey', 'email_body')} * 4)::INT AS body,
  {_pick('department', synth.DEPARTMENTS)} AS department,
  {_pick('file_type', synth.USB_FILE_TYPES)} AS usb_type, {_pick('file_type', synth.CLOUD_FILE_TYPES)} AS cloud_type,
  {_pick('file', synth.USB_FILES)} AS usb_file, {_pick('file', synth.CLOUD_FILES)} AS cloud_file,
  {_pick('service', synth.CLOUD_SERVICES)} AS service, {_pick('document', synth.DOCUMENT_TYPES)} AS document,
  {_pick('severity', ['High', 'Critical'])} AS s_hc, {_pick('severity', ['Medium', 'High'])} AS s_mh,
  {_pick('severity', ['Low', 'Medium'])} AS s_lm, {_pick('severity', ['Medium', 'High', 'High'])} AS s_mhh,
  {_pick('severity', ['Low', 'Medium', 'Medium'])} AS s_lmm,
  {_pick('usb_template', synth.USB_TEMPLATES)} AS t_usb, {_pick('cloud_template', synth.CLOUD_TEMPLATES)} AS t_cloud,
  {_pick('printer_template', synth.PRINTER_TEMPLATES)} AS t_printer, {_pick('email_body', synth.EMAIL_TEMPLATES)} AS t_email,
  {_PAYLOAD}
  FROM orders)"""
_FILE = """CASE incident_type WHEN 'usb' THEN usb_file || '.' || usb_type WHEN 'cloud' THEN cloud_file || '.' || cloud_type END"""
_TEXT = """CASE incident_type WHEN 'email' THEN t_email WHEN 'usb' THEN t_usb WHEN 'cloud' THEN t_cloud ELSE t_printer END"""
for _name in ("name", "phone", "card", "passport", "inn", "snils"):
    _TEXT = f"replace({_TEXT}, '{{{_name}}}', {_name})"
_TEXT = f"replace(replace(replace({_TEXT}, '{{file}}', coalesce({_FILE}, '')), '{{service}}', service), '{{document}}', document)"
# What a text holds follows from its template: the payload values of the placeholders in it.
_HELD = """CASE incident_type WHEN 'email' THEN t_email WHEN 'usb' THEN t_usb WHEN 'cloud' THEN t_cloud ELSE t_printer END"""


def _held(name: str) -> str:
    return f"CASE WHEN contains({_HELD}, '{{{name}}}') THEN {name} ELSE '' END"


def _days(salt: str, low: int, high: int) -> str:
    return f"(TIMESTAMP '{synth.ANCHOR}' - to_days({_int(salt, low, high)}::INT))"


_HOURS = "[" + ", ".join(str(h) for h, w in synth.HOUR_WEIGHTS.items() for _ in range(w)) + "]"
_AGAIN = f"""(isodow({_days('day0', 1, 365)}) = 5 AND {draw_sql('o_orderkey', 'friday')} < 0.3)
  OR (isodow({_days('day0', 1, 365)}) >= 6 AND {draw_sql('o_orderkey', 'weekend')} < 0.7)"""

QUERIES = {
    "synth_payload": synth_payload,
    "synth_labels": synth_labels,
    "synth_texts": synth_texts,
    "synth_times": synth_times,
    "synth_incidents": synth_incidents,
    "synth_enhanced": synth_enhanced,
    "typos": typos,
}

ORACLES = {
    "synth_payload": f"SELECT o_orderkey, {_PAYLOAD} FROM orders",
    "synth_labels": f"""WITH {_KIND} SELECT o_orderkey, incident_type,
  CASE incident_type WHEN 'email' THEN CASE WHEN ext THEN s_hc ELSE s_lm END WHEN 'usb' THEN s_hc WHEN 'cloud' THEN s_mhh
    ELSE s_lmm END AS severity,
  CASE WHEN incident_type = 'email' THEN ext END AS is_external_recipient, department, {_FILE} AS file_name,
  CASE WHEN incident_type = 'cloud' THEN service END AS cloud_service,
  CASE WHEN incident_type = 'printer' THEN document END AS document_type FROM k""",
    "synth_texts": f"""WITH {_KIND} SELECT o_orderkey,
  'INC-' || CASE WHEN o_orderkey < 1000000 THEN lpad(o_orderkey::VARCHAR, 6, '0') ELSE o_orderkey::VARCHAR END AS incident_id,
  {_TEXT} AS description, {_held('card')} AS cards, {_held('passport')} AS passports, {_held('inn')} AS inn,
  {_held('snils')} AS snils, array_to_string(regexp_extract_all({_TEXT}, '(\\+7|8)[\\s\\-\\(]?\\d{{3}}[\\s\\-\\)]?\\d{{3}}[\\s\\-]?\\d{{2}}[\\s\\-]?\\d{{2}}', 0), '|') AS phones,
  '' AS emails,
  CASE WHEN contains({_HELD}, '{{passport}}') AND contains({_HELD}, '{{card}}') THEN 'Critical'
       WHEN contains({_HELD}, '{{passport}}') OR contains({_HELD}, '{{card}}') THEN 'High'
       WHEN contains({_HELD}, '{{inn}}') AND contains({_HELD}, '{{snils}}') THEN 'Medium' ELSE 'Low' END AS risk_level
FROM k""",
    "synth_times": f"""SELECT o_orderkey, strftime({_days('days', 0, 90)}, '%Y-%m-%d %H:%M:%S') AS recent,
  strftime(date_trunc('day', CASE WHEN {_AGAIN} THEN {_days('day1', 1, 365)} ELSE {_days('day0', 1, 365)} END)
    + to_hours({_HOURS}[floor({draw_sql('o_orderkey', 'hour')} * {sum(synth.HOUR_WEIGHTS.values())})::INT + 1])
    + to_minutes({_int('minute', 0, 59)}) + to_seconds({_int('second', 0, 59)}), '%Y-%m-%d %H:%M:%S') AS working
FROM orders""",
}

"""Detection against the documented cases and against Python's own regexes."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakscan.functions.detect import detect_pii, detected_types, pii_matches
from leakscan.functions.rules import RULE_SETS, jvm_pattern, rule_set
from leakscan.operators.findings import pii_findings, with_pii


def detect(spark, text, **kwargs):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return with_pii(df, "text", **kwargs).first()["pii"]


MIXED = """Здравствуйте! Карта: 1234 5678 9012 3456, паспорт: 4567 123456, ИНН: 123456789012,
СНИЛС: 123-456-789 12, телефон: +7 900 123-45-67, email: client@example.com"""


@pytest.mark.parametrize(
    "text, field, n",
    [
        ("Карта: 1234 5678 9012 3456", "cards", 1),
        ("Паспорт: 1234 567890", "passports", 1),
        ("ИНН: 123456789012", "inn", 1),
        ("СНИЛС: 123-456-789 01", "snils", 1),
        ("+7 (900) 123-45-67, 8-800-555-35-35, +79001234567", "phones", 2),
        ("ivan@example.com и maria.petrova@company.ru", "emails", 2),
        ("1111 2222 3333 4444, 5555 6666 7777 8888, 9999 0000 1111 2222", "cards", 3),
        ("1234 5678", "cards", 0),
        ("abcd efgh ijkl mnop", "cards", 0),
        ("1234 5678 9012 3456", "cards", 1),
        ("١٢٣٤ ٥٦٧٨٩٠", "passports", 1),
    ],
)
def test_rules(spark, text, field, n):
    assert len(detect(spark, text)[field]) == n


@pytest.mark.parametrize("text, n", [("1234 5678 9012 3456", 1), ("1234-5678-9012-3456", 1), ("1234567890123456", 1), ("1234 5678", 0)])
def test_extended_cards(spark, text, n):
    assert len(detect(spark, text, rules="extended")["cards"]) == n


def test_everything_at_once(spark):
    pii = detect(spark, MIXED)
    assert (pii["pii_count"], pii["has_pii"], pii["risk_level"]) == (6, True, "Critical")
    assert pii["phones"] == ["+7 900 123-45-67"]
    assert pii["detection_method"] == "regex only"


@pytest.mark.parametrize("text", ["", None, "Обычное письмо без данных"])
def test_nothing_found(spark, text):
    pii = detect(spark, text)
    assert (pii["pii_count"], pii["has_pii"], pii["risk_level"]) == (0, False, "Low")
    assert all(pii[f] == [] for f in ("cards", "passports", "inn", "snils", "phones", "emails", "persons", "orgs", "locations"))


@pytest.mark.parametrize(
    "text, risk",
    [
        ("4567 123456 и 1234 5678 9012 3456", "Critical"),
        ("4567 123456", "High"),
        ("1234 5678 9012 3456", "High"),
        ("123456789012 и 123-456-789 12", "Medium"),
        ("123456789012", "Low"),
        ("+79001234567 a@b.com", "Low"),
    ],
)
def test_risk(spark, text, risk):
    assert detect(spark, text)["risk_level"] == risk


def test_persons_count_organisations_do_not(spark):
    df = spark.createDataFrame([("ИНН 123456789012", ["Иванов"], ["ООО"])], "text string, who array<string>, orgs array<string>")
    pii = with_pii(df, "text", persons="who", orgs="orgs").first()["pii"]
    assert (pii["pii_count"], pii["risk_level"], pii["detection_method"]) == (2, "Medium", "hybrid (regex + ner)")
    assert pii["orgs"] == ["ООО"]


def test_phone_prefix_quirk(spark):
    df = spark.createDataFrame([("+79001234567 8-800-555-35-35",)], "text string")
    assert df.select(pii_matches("text", "phone", group=1)).first()[0] == ["+7", "8"]


def test_single_expression_equals_operator(spark):
    df = spark.createDataFrame([(MIXED,), ("",), (None,)], "text string")
    both = with_pii(df, "text").withColumn("direct", detect_pii("text"))
    assert both.filter(~F.col("pii").eqNullSafe(F.col("direct"))).count() == 0


def test_types_and_findings(spark):
    df = spark.createDataFrame([(1, MIXED), (2, "пусто"), (3, None)], "id int, text string")
    types = with_pii(df, "text").orderBy("id").select(detected_types(F.col("pii")).alias("t")).first()["t"]
    assert types == ["card", "passport", "inn", "snils", "phone", "email"]
    found = pii_findings(df, "id", "text").collect()
    assert len(found) == 6 and {r["id"] for r in found} == {1}


def test_unknown_rules(spark):
    with pytest.raises(ValueError):
        rule_set("other")
    with pytest.raises(ValueError):
        pii_matches("text", "iban")


ALPHABET = "0123456789  -+().@_aZяЁé²٣́\x1c\x85,\n"
PIECES = ["1234 5678 9012 3456", "4567 123456", "123456789012", "123-456-789 12", "+7900 1234567", "8(900)123-45-67", "a.b@c.ru", "é.x@y.com"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.lists(st.one_of(st.text(ALPHABET, max_size=6), st.sampled_from(PIECES)), max_size=8).map("".join), min_size=60, max_size=60
    )
)
@pytest.mark.parametrize("name", sorted(RULE_SETS))
def test_same_matches_as_python(spark, name, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", *[pii_matches("text", r, name).alias(r) for r in rule_set(name)]).collect()
    for row in rows:
        for rule, pattern in rule_set(name).items():
            assert row[rule] == [m.group(0) for m in re.finditer(pattern, row["text"])], (rule, row["text"])


def test_translation_keeps_other_escapes():
    assert jvm_pattern(r"\.\-a") == r"\.\-a"

"""Personal-data detection as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions.rules import EMAIL_SIGN, THREE_DIGITS, email_pattern, jvm_pattern, needs_digits, needs_sign, rule_set

# Field of the detection struct that holds the matches of each rule.
MATCH_FIELDS = {
    "card": "cards",
    "passport": "passports",
    "inn": "inn",
    "snils": "snils",
    "phone": "phones",
    "email": "emails",
}
ENTITY_FIELDS = ("persons", "orgs", "locations")
RISK_LEVELS = ("Low", "Medium", "High", "Critical")
PII_FEATURES = ("has_card", "has_passport", "has_inn", "has_snils", "has_phone", "has_email", "pii_count")

METHOD_REGEX = "regex only"
METHOD_HYBRID = "hybrid (regex + ner)"


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def text_or_empty(col: Column | str) -> Column:
    """Null text counts as empty text in every text operator."""
    return F.coalesce(_column(col), F.lit(""))


def pii_matches(col: Column | str, rule: str, rules: str | dict[str, str] = "base", group: int = 0) -> Column:
    """All matches of one rule in reading order; an empty array for null or empty text.

    ``group=1`` of the phone rule returns the prefix only (``+7`` or ``8``); the number of matches is the same.
    """
    patterns = rule_set(rules)
    if rule not in patterns:
        raise ValueError(f"unknown rule {rule!r}; known: {', '.join(patterns)}")
    text = text_or_empty(col)
    if needs_sign(patterns[rule]):
        found = F.regexp_extract_all(text, F.lit(email_pattern()), F.lit(1))
        return F.when(F.contains(text, F.lit(EMAIL_SIGN)), found).otherwise(_no_strings())
    found = F.regexp_extract_all(text, F.lit(jvm_pattern(patterns[rule])), F.lit(group))
    if needs_digits(patterns[rule]):
        return F.when(F.rlike(text, F.lit(THREE_DIGITS)), found).otherwise(_no_strings())
    return found


def match_fields(rules: str | dict[str, str] = "base") -> dict[str, str]:
    """Struct field of each rule: the six built-in ones, then a caller's further rules under their own names."""
    more = {name: name for name in rule_set(rules) if name not in MATCH_FIELDS}
    taken = {*MATCH_FIELDS.values(), *ENTITY_FIELDS, "has_pii", "pii_count", "risk_level", "detection_method"}
    if taken & more.keys():
        raise ValueError(f"rule names that are fields already: {', '.join(sorted(taken & more.keys()))}")
    return {**MATCH_FIELDS, **more}


def match_struct(
    col: Column | str,
    rules: str | dict[str, str] = "base",
    persons: Column | str | None = None,
    orgs: Column | str | None = None,
    locations: Column | str | None = None,
    phone_group: int = 0,
) -> Column:
    """The match arrays of a text: of the built-in rules, of further rules of the caller's map, and of entities.

    A built-in rule that the map lacks finds nothing. Entities come from the caller's own columns, if there are any.
    """
    known = rule_set(rules)
    fields = [
        (pii_matches(col, rule, rules, phone_group if rule == "phone" else 0) if rule in known else _no_strings()).alias(field)
        for rule, field in match_fields(rules).items()
    ]
    for field, entity in zip(ENTITY_FIELDS, (persons, orgs, locations)):
        value = _no_strings() if entity is None else F.coalesce(_column(entity), _no_strings())
        fields.append(value.alias(field))
    return F.struct(*fields)


def risk_level(matches: Column) -> Column:
    """Risk by kind of data: passport and card together, either one, two or more kinds, anything else.

    Phones, e-mails, organisations and locations never raise the level.
    """
    has = {f: F.size(matches[f]) > 0 for f in ("cards", "passports", "inn", "snils", "persons")}
    kinds = reduce(add, (h.cast("int") for h in has.values()))
    return (
        F.when(has["passports"] & has["cards"], "Critical")
        .when(has["passports"] | has["cards"], "High")
        .when(kinds >= 2, "Medium")
        .otherwise("Low")
    )


def pii_count(matches: Column, rules: str | dict[str, str] = "base") -> Column:
    """Matches of all rules plus persons; organisations and locations do not count."""
    return reduce(add, (F.size(matches[f]) for f in (*match_fields(rules).values(), "persons")))


def detection(matches: Column, hybrid: bool = False, rules: str | dict[str, str] = "base") -> Column:
    """The full detection struct from a column of match arrays."""
    count = pii_count(matches, rules)
    arrays = [matches[f].alias(f) for f in (*match_fields(rules).values(), *ENTITY_FIELDS)]
    return F.struct(
        *arrays,
        (count > 0).alias("has_pii"),
        count.alias("pii_count"),
        risk_level(matches).alias("risk_level"),
        F.lit(METHOD_HYBRID if hybrid else METHOD_REGEX).alias("detection_method"),
    )


def detect_pii(
    col: Column | str,
    rules: str | dict[str, str] = "base",
    persons: Column | str | None = None,
    orgs: Column | str | None = None,
    locations: Column | str | None = None,
    phone_group: int = 0,
) -> Column:
    """Detection struct of one text column. Over tables prefer :func:`leakscan.operators.findings.with_pii`."""
    return detection(match_struct(col, rules, persons, orgs, locations, phone_group), persons is not None, rules)


def detected_types(pii: Column, rules: str | dict[str, str] = "base") -> Column:
    """Names of the rules with at least one match, in rule order."""
    found = [F.when(F.size(pii[f]) > 0, F.lit(rule)) for rule, f in match_fields(rules).items()]
    return F.array_compact(F.array(*found))


def pii_features(pii: Column, use_pii: bool = True) -> list[Column]:
    """Six 0/1 columns and the count; all zero when detection is switched off."""
    if not use_pii:
        return [F.lit(0).alias(name) for name in PII_FEATURES]
    flags = [(F.size(pii[f]) > 0).cast("int").alias(f"has_{rule}") for rule, f in MATCH_FIELDS.items()]
    return [*flags, pii["pii_count"].alias("pii_count")]

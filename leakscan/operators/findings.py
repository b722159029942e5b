"""Personal-data detection over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions.detect import detection, match_fields, match_struct


def with_pii(
    df: DataFrame,
    text_col: str,
    rules: str | dict[str, str] = "base",
    persons: Column | str | None = None,
    orgs: Column | str | None = None,
    locations: Column | str | None = None,
    phone_group: int = 0,
    into: str = "pii",
) -> DataFrame:
    """Adds the detection struct of a text column.

    Matches and conclusions are two projections: every rule runs once per row however many fields are read later.
    """
    held = f"_{into}_matches"
    matched = df.withColumn(held, match_struct(text_col, rules, persons, orgs, locations, phone_group))
    return matched.withColumn(into, detection(F.col(held), persons is not None, rules)).drop(held)


def pii_findings(df: DataFrame, id_col: str, text_col: str, rules: str | dict[str, str] = "base") -> DataFrame:
    """Long table of matches ``(id, pii_type, match, pos)``; rules without a match have no row."""
    matches = df.select(F.col(id_col), match_struct(text_col, rules).alias("m"))
    per_rule = F.array(
        *[F.struct(F.lit(rule).alias("pii_type"), F.col("m")[field].alias("found")) for rule, field in match_fields(rules).items()]
    )
    typed = matches.select(id_col, F.explode(per_rule).alias("r"))
    return typed.select(id_col, F.col("r.pii_type"), F.posexplode("r.found").alias("pos", "match")).select(
        id_col, "pii_type", "match", "pos"
    )

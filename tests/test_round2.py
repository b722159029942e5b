"""Rules of a caller's map, linear matching, nulls and offsets."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan.functions.detect import detect_pii, detected_types, pii_matches
from leakscan.functions.rules import BASE_RULES
from leakscan.functions.temporal import hour_of_day, parse_ts
from leakscan.operators.findings import pii_findings, with_pii
from leakscan.operators.metrics import accuracy, confusion, macro_scores
from leakscan.operators.neighbours import knn
from leakscan.operators.vectors import project_2d
from leakscan.session import shared_dir
from leakscan.sources.vectors import save_vectors

US_PHONE = {"us_phone": r"\+1 \(\d{3}\) \d{3}-\d{4}"}


def test_email_equals_re(spark):
    rng = np.random.default_rng(5)
    pieces = ["a", "b.", "@", ".c", "d.org", "é", "_", "-", " ", "%", "+", "co", ".", "1", "\n"]
    texts = ["a@b.com.c@d.org", "éfoo.bar@x.com", "x@y.com@z.org", ".a@b.cc", "a..b@c.de f@g.hi"]
    texts += ["".join(rng.choice(pieces, rng.integers(1, 24))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pii_matches("t", "email").alias("m")).collect()
    assert all(re.findall(BASE_RULES["email"], r["t"]) == r["m"] for r in rows)


def test_email_is_linear(spark):
    df = spark.createDataFrame([("a." * 500_000 + "@",)], "t string")
    start = time.perf_counter()
    assert df.select(F.size(pii_matches("t", "email"))).first()[0] == 0
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("rules", [{**BASE_RULES, **US_PHONE}, US_PHONE])
def test_further_rules(spark, rules):
    df = spark.createDataFrame([(1, "call +1 (555) 123-4567 or a@b.com")], "id int, t string")
    pii = with_pii(df, "t", rules).select("pii.*", detected_types(F.col("pii"), rules).alias("types")).first()
    assert pii["us_phone"] == ["+1 (555) 123-4567"]
    assert pii["pii_count"] == 1 + ("email" in rules) == len(pii["types"])
    assert {r["pii_type"] for r in pii_findings(df, "id", "t", rules).collect()} == set(pii["types"])
    assert df.select(detect_pii("t", rules).alias("p")).first()["p"]["has_pii"]


def test_rule_named_like_a_field(spark):
    with pytest.raises(ValueError):
        detect_pii(F.lit("x"), {"persons": "x"})


def test_nulls_in_metrics(spark):
    df = spark.createDataFrame([("a", "a"), (None, None), (None, "a"), ("b", "a")], "x string, y string")
    assert accuracy(df, "x", "y").first()[0] == 0.5 == macro_scores(df, "x", "y").first()["accuracy"]
    cells = {(r["actual"], r["predicted"]): r["n"] for r in confusion(df, "x", "y").collect()}
    assert len(cells) == 9 and sum(cells.values()) == 4 and cells[None, "a"] == 1


@pytest.mark.parametrize("text, hour", [
    ("2024-01-15T14:30:00+03:00", 14), ("2024-01-15 14:30:00Z", 14), ("2024-01-15T14:30:00.5-0500", 14),
    ("2024-01-15", 0), ("15.01.2024 14:30", 14), ("nothing", 12),
])
def test_offsets_keep_the_written_hour(spark, text, hour):
    ts = parse_ts(F.lit(text), ["dd.MM.yyyy HH:mm"])
    assert spark.range(1).select(hour_of_day(ts)).first()[0] == hour


def test_null_ids_are_no_neighbours(spark):
    rows = [(1, [0.0, 1.0]), (None, [0.0, 1.0]), (2, [1.0, 0.0])]
    corpus = spark.createDataFrame(rows, "id int, embedding array<double>")
    found = knn(corpus, corpus.withColumnRenamed("id", "query_id"), 5).collect()
    assert {(r["query_id"], r["id"]) for r in found} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_projection_keeps_all_rows(spark):
    df = spark.range(5500).select("id", F.array(*[F.rand(i) for i in range(3)]).alias("embedding"))
    assert project_2d(df).count() == 5500


def test_widths_are_checked_in_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0])], "id int, embedding array<double>")
    with pytest.raises(Exception, match="different widths"):
        save_vectors(df, str(tmp_path / "v"))


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared_dir(Session())

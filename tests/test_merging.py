"""Ranged category codes, distinct counts that merge, and k-means with all restarts at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan.operators.categories import apply_codes, fit_codes
from leakscan.operators.profile import distinct_sketches, merged_cardinality
from leakscan.operators.restarts import assign, fit_restarts
from leakscan.operators.vectors import kmeans_model


@pytest.mark.parametrize("per_range", [1, 7, 10_000])
def test_ranged_codes_are_dense_and_ordered(spark, per_range):
    words = [f"{'long' * 100 if i % 5 == 0 else ''}{chr(0x61 + i % 700)}{i}" for i in range(40)] + [None, "", "unknown"]
    df = spark.createDataFrame([(w,) for w in words * 3], "c string")
    codes = {r["value"]: r["code"] for r in fit_codes(df, "c", max_local=2, per_range=per_range).collect()}
    expected = sorted({w if w is not None else "unknown" for w in words}, key=lambda w: w.encode("utf-8"))
    assert codes == {w: i for i, w in enumerate(expected)}


def test_codes_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "c string")
    codes = fit_codes(empty, "c", max_local=0)
    assert codes.count() == 0 and apply_codes(empty, "c", codes).count() == 0


def test_sketches_merge(spark):
    df = spark.range(30_000).select((F.col("id") % 9000).alias("a"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("b"), F.lit(None).cast("int").alias("c"))
    parts = [df.filter(F.col("a") < 6000), df.filter(F.col("a") >= 3000)]  # values of the middle are in both
    stored = distinct_sketches(parts[0], ["a", "b", "c"]).unionByName(distinct_sketches(parts[1], ["a", "b", "c"], power=12))
    stored = stored.unionByName(distinct_sketches(df.limit(0), ["a", "b", "c"]))
    got = {r["column_name"]: r for r in merged_cardinality(stored).collect()}
    assert abs(got["a"]["n_distinct"] - 9000) < 0.05 * 9000
    assert (got["b"]["n_distinct"], got["c"]["n_distinct"]) == (1, 0)
    assert got["c"]["n_missing"] == got["c"]["n_rows"] == sum(p.count() for p in parts)


def _points(n=1200, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 5
    return centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 8))


def test_restarts_cost_no_more_than_separate_fits(spark):
    points = _points()
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>").repartition(5)
    got = fit_restarts(df, k=6, n_init=4)
    separate = [kmeans_model(df, 6, seed=42 + i, n_init=1).summary.trainingCost for i in range(4)]
    assert got.cost == min(got.costs) and got.cost <= min(separate) * (1 + 1e-6)
    assert got.passes <= 1 + 2 * 3 + 1 + 20 + 1
    nearest = ((points[:, None, :] - got.centres[None]) ** 2).sum(axis=2)
    assert abs(nearest.min(axis=1).sum() - got.cost) < 1e-6 * got.cost
    told = {r["id"]: r["cluster"] for r in assign(df, got.centres).collect()}
    assert [told[i] for i in range(len(points))] == nearest.argmin(axis=1).tolist()


def test_restarts_of_odd_rows(spark):
    rows = [(None,), ([1.0, float("nan")],), ([1.0, None],), ([float("inf"), 0.0],)] + [([1.0, 2.0],)] * 500 + [([3.0, 4.0],)]
    df = spark.createDataFrame(rows, "embedding array<double>")
    got = fit_restarts(df, k=5, n_init=3)
    assert sorted(map(tuple, got.centres.tolist())) == [(1.0, 2.0), (3.0, 4.0)] and got.cost < 1e-9
    assert assign(df.limit(0), got.centres).count() == 0
    assert assign(df.filter("embedding is null"), got.centres).first()["cluster"] is None
    with pytest.raises(ValueError):
        fit_restarts(df.filter("embedding is null"))

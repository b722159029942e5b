"""Exact quantiles of large groups by distributed selection.

Spark's own ``percentile`` keeps every distinct value of a group in one buffer. Here each rank that is asked for has a bracket, at
first the whole range of its group and column. A round cuts every bracket into buckets, counts them in one aggregation and keeps
the bucket in which the rank falls, with its least and greatest value as the new bracket. Once a bracket holds few rows, or one
value only, its rows are sorted. A round divides a bracket by the number of buckets, so two or three rounds do for any
number of rows. What a task or an exchange holds is bounded by brackets times buckets, not by rows or distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.operators.lookup import bounded_lookup
from leakscan.session import materialise

#: Buckets that a round cuts a bracket into, and rows from which on a bracket is cut rather than sorted.
BUCKETS = 4096
_LARGEST = 1.7976931348623157e308


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """``(by..., column, q, value)`` with linear interpolation between the two nearest ranks.

    Nulls and NaN do not count; a group whose column has no other value is left out. Infinite values are values. ``df`` is
    read once per round and twice more, so materialise what is dear to compute.
    """
    key = [*by, "column"]
    held = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]
    values = df.select(*by, F.explode(F.array(*held)).alias("x")).select(*by, "x.column", "x.v")
    values = values.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    groups = values.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    position = F.col("q") * (F.col("n") - 1)
    asked = groups.select("*", F.explode(F.array(*[F.lit(float(q)) for q in probabilities])).alias("q")).withColumns(
        {"lower": F.floor(position), "upper": F.ceil(position), "fraction": position - F.floor(position)}
    )
    asked = materialise(asked, "quantile-ranks")
    rank = F.explode(F.array("lower", "upper")).alias("rank")
    brackets = asked.select(*key, "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), rank).distinct()
    found, turn = _found(brackets, key, by), 0
    while True:
        brackets = materialise(brackets.filter("low < high"), "quantile-brackets")
        if brackets.filter(F.col("inside") > buckets).isEmpty():
            break
        cut = _cut(values, brackets.filter(F.col("inside") > buckets), key, buckets, logarithmic=turn % 2 == 1)
        brackets = materialise(brackets.filter(F.col("inside") <= buckets).unionByName(cut), "quantile-cut")
        found, turn = found.unionByName(_found(brackets, key, by)), turn + 1
    found = found.unionByName(_sorted(values, brackets, key))
    ranked = bounded_lookup(_renamed(found, key))
    lower, upper = (ranked.withColumnsRenamed({"rank": f"_{s}", "value": f"{s}_value"}) for s in ("low", "high"))
    out = asked
    for side, rank_col, table in (("low", "lower", lower), ("high", "upper", upper)):
        out = out.join(table, [*_same(key), F.col(rank_col) == F.col(f"_{side}")]).drop(*[f"_{k}" for k in key], f"_{side}")
    gap = (F.col("high_value") - F.col("low_value")) * F.col("fraction")
    value = F.when(F.col("low_value") == F.col("high_value"), F.col("low_value")).otherwise(F.col("low_value") + gap)
    return out.select(*key, "q", value.alias("value"))


def _renamed(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in key})


def _same(key: Sequence[str]) -> list[Column]:
    """The key of one side equals the renamed one of the other; a null group equals a null group."""
    return [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]


def _found(brackets: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Ranks whose bracket has come down to one value."""
    return brackets.filter("low = high").select(*key, "rank", F.col("low").alias("value"))


def _inside(values: DataFrame, brackets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Values next to the bracket they fall into; brackets of a group and column are equal or apart."""
    edges = bounded_lookup(_renamed(brackets.select(*key, "low", "high").distinct(), key))
    met = values.join(edges, _same(key)).filter(F.col("v").between(F.col("low"), F.col("high")))
    return met.drop(*[f"_{k}" for k in key])


def _bucket(buckets: int, logarithmic: bool) -> Column:
    """Number of the bucket of ``v`` in [low, high]; never falls as v grows, 0 at low and the last one at high.

    Buckets are equally wide, or, in every second round, equally wide in the logarithm where the bracket spans several
    orders of magnitude: values that lie close together beside a far outlier would else take a round for each factor
    of ``buckets``.
    """
    clamp = lambda c: F.greatest(F.least(F.col(c), F.lit(_LARGEST)), F.lit(-_LARGEST)) * 0.5
    v, low, high = clamp("v"), clamp("low"), clamp("high")
    share = (v - low) / F.nullif(high - low, F.lit(0.0))
    if logarithmic:
        far, near = F.greatest(F.abs(low), F.abs(high)), F.least(F.abs(low), F.abs(high))
        scaled = lambda x: F.signum(x) * F.log1p(F.abs(x) / (far * 2.0**-60))
        width = scaled(high) - scaled(low)
        spans = (low * F.signum(high) <= 0) | (far > buckets * near)
        share = F.when(spans & (width > 0), (scaled(v) - scaled(low)) / width).otherwise(share)
    inner = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1))
    return F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), buckets - 1).otherwise(inner)


def _cut(values: DataFrame, brackets: DataFrame, key: Sequence[str], buckets: int, logarithmic: bool) -> DataFrame:
    """The brackets after one round: of each the bucket that holds its rank."""
    counted = (
        _inside(values, brackets, key)
        .withColumn("bucket", _bucket(buckets, logarithmic))
        .groupBy(*key, "low", "bucket")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
    )
    running = Window.partitionBy(*key, "low").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most ``buckets`` rows
    placed = _renamed(counted.withColumn("upto", F.sum("rows").over(running)), [*key, "low"])
    holds = (F.col("before") + F.col("upto") - F.col("rows") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("upto"))
    return brackets.join(placed, _same([*key, "low"])).filter(holds).select(
        *key, F.col("least").alias("low"), F.col("most").alias("high"),
        (F.col("before") + F.col("upto") - F.col("rows")).alias("before"), F.col("rows").alias("inside"), "rank",
    )


def _sorted(values: DataFrame, brackets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Ranks of brackets with few rows, whose number the last round has counted."""
    listed = _inside(values, brackets, key).groupBy(*key, "low").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    both = brackets.join(_renamed(listed, [*key, "low"]), _same([*key, "low"]))
    return both.select(*key, "rank", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("value"))

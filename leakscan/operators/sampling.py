"""Exact seeded samples and splits that do not depend on partitioning.

Rows are ranked by a draw on their key, which must identify the row. A global or per-class sort would put a whole class
in one task, so the draw is cut into equal buckets. Bucket counts (partially aggregated) show in which bucket the cut
falls, the keys of that bucket alone are ranked to find the last row taken, and every row is then compared with that
cut point where it stands: the rows themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.functions.draws import draw
from leakscan.operators.lookup import bounded_lookup

BUCKETS = 65_536


def _bucket(u: Column) -> Column:
    return F.floor(u * BUCKETS).cast("int")


def _cut_points(df: DataFrame, by: Column, key: str, seed: int, want: Column) -> DataFrame:
    """``(_class, _cut_u, _cut_key)``: draw and key of the last row taken from each class.

    ``want`` is the number of rows to take, in terms of the class size ``size``. Classes that give no row are absent.
    """
    keys = df.select(by.alias("_class"), F.col(key).alias("_key")).withColumn("_u", draw(F.col("_key"), seed))
    keys = keys.withColumn("_b", _bucket(F.col("_u")))
    counts = keys.groupBy("_class", "_b").agg(F.count(F.lit(1)).alias("n"))
    per_class = Window.partitionBy("_class")
    cumulative = counts.select(
        "_class",
        "_b",
        (F.sum("n").over(per_class.orderBy("_b")) - F.col("n")).alias("before"),
        F.col("n"),
        F.sum("n").over(per_class).alias("size"),
    ).withColumn("want", want)
    cuts = cumulative.filter((F.col("before") < F.col("want")) & (F.col("want") <= F.col("before") + F.col("n"))).select(
        F.col("_class").alias("_c"), F.col("_b").alias("_cut"), (F.col("want") - F.col("before")).alias("_take")
    )
    on_cut = keys.join(bounded_lookup(cuts), F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_cut")))
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_u", "_key"))
    return (
        on_cut.withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_take"))
        .select("_class", F.col("_u").alias("_cut_u"), F.col("_key").alias("_cut_key"))
    )


def _is_taken(key: str) -> Column:
    u, cut = F.col("_u"), F.col("_cut_u")
    return F.coalesce((u < cut) | ((u == cut) & (F.col(key) <= F.col("_cut_key"))), F.lit(False))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): those with the smallest draws."""
    want = F.least(F.lit(n).cast("long"), F.col("size"))
    cuts = _cut_points(df, F.lit(0), key, seed, want).collect()
    if not cuts:
        return df.limit(0)
    drawn = df.withColumn("_u", draw(F.col(key), seed))
    cut = drawn.withColumn("_cut_u", F.lit(cuts[0]["_cut_u"])).withColumn("_cut_key", F.lit(cuts[0]["_cut_key"]))
    return cut.filter(_is_taken(key)).drop("_u", "_cut_u", "_cut_key")


def stratified_split(
    df: DataFrame, by: str, key: str, fraction: float = 0.2, seed: int = 42, into: str = "is_test"
) -> DataFrame:
    """Marks ``round(fraction * class size)`` rows of each class as test rows: those with the smallest draws."""
    want = F.round(F.col("size") * F.lit(float(fraction))).cast("long")
    cuts = bounded_lookup(_cut_points(df, F.col(by), key, seed, want))
    drawn = df.withColumn("_u", draw(F.col(key), seed))
    joined = drawn.join(cuts, F.col(by).eqNullSafe(F.col("_class")), "left")
    return joined.withColumn(into, _is_taken(key)).drop("_u", "_class", "_cut_u", "_cut_key")


def class_weights(df: DataFrame, by: str) -> DataFrame:
    """``(class, n, weight)`` with balanced weights ``total / (classes * n)``."""
    counts = df.groupBy(F.col(by).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    share = counts.agg((F.sum("n") / F.count(F.lit(1))).alias("share")).scalar()
    return counts.withColumn("weight", share / F.col("n"))


def with_weight(df: DataFrame, by: str, weights: DataFrame | None = None, into: str = "weight") -> DataFrame:
    """Adds the class weight of each row."""
    weights = class_weights(df, by) if weights is None else weights
    lookup = bounded_lookup(weights.select(F.col("class").alias("_class"), F.col("weight").alias(into)))
    return df.join(lookup, F.col(by).eqNullSafe(F.col("_class")), "left").drop("_class")

"""Category codes: values numbered in code-point order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscan.operators.lookup import BROADCAST_ROWS, bounded_lookup
from leakscan.session import materialise

UNKNOWN_VALUE = "unknown"
UNSEEN_CODE = -1
#: Values that one task numbers where there are more than the driver takes.
RANGE_VALUES = 1_000_000
#: Leading characters by which values are dealt to ranges: the driver sees samples of these, never whole values.
_LEADING = 256
#: ``monotonically_increasing_id`` holds the row within its partition in these bits.
_ROW_BITS = 33
_MOST_CODES = 2**31 - 1


def fit_codes(df: DataFrame, col: str, max_local: int = BROADCAST_ROWS, per_range: int = RANGE_VALUES) -> DataFrame:
    """``(value, code)`` with codes 0..k-1 in code-point order; null counts as ``unknown``.

    The distinct values are written once. Up to ``max_local`` of them are numbered on the driver; more are numbered in as
    many ranges as their count asks for, so that no task sorts them all.
    """
    spark = df.sparkSession
    found = df.select(F.coalesce(F.col(col).cast("string"), F.lit(UNKNOWN_VALUE)).alias("value")).distinct()
    values = materialise(found, "values")
    count = values.count()
    if count > _MOST_CODES:
        raise ValueError(f"{count} values of {col!r} exceed an integer code")
    if count <= max_local:
        # Code-point order is the order of the UTF-8 bytes, which is also Spark's string order.
        ordered = sorted((r.value for r in values.collect()), key=lambda v: v.encode("utf-8"))
        return spark.createDataFrame([(v, i) for i, v in enumerate(ordered)], "value string, code int")
    return _number_ranges(values, -(-count // per_range))


def _number_ranges(values: DataFrame, ranges: int) -> DataFrame:
    """Dense numbers of distinct strings in two phases: places within sorted ranges, then the sizes of earlier ranges.

    Places are written with their range, so a retried task can't deal values to other ranges than those that were counted.
    """
    place = F.monotonically_increasing_id()
    dealt = values.repartitionByRange(ranges, F.left("value", F.lit(_LEADING))).sortWithinPartitions("value")
    placed = materialise(dealt.select("value", place.alias("place")), "places").select(
        "value", F.shiftright("place", _ROW_BITS).alias("range"), F.col("place").bitwiseAND((1 << _ROW_BITS) - 1).alias("row")
    )
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row per range, not per value
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = bounded_lookup(sizes.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    return placed.join(starts, "range").select("value", (F.col("start") + F.col("row")).cast("int").alias("code"))


def apply_codes(df: DataFrame, col: str, codes: DataFrame, into: str | None = None) -> DataFrame:
    """Adds ``encoded_<col>``; a value not seen at fit gets -1. The dimension is broadcast if it is small."""
    into = into or f"encoded_{col}"
    lookup = bounded_lookup(codes.select(F.col("value").alias("__value"), F.col("code").alias("__code_of")))
    value = F.coalesce(F.col(col).cast("string"), F.lit(UNKNOWN_VALUE))
    return (
        df.join(lookup, value == F.col("__value"), "left")
        .withColumn(into, F.coalesce("__code_of", F.lit(UNSEEN_CODE)))
        .drop("__value", "__code_of")
    )

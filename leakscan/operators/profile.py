"""Profiling of incident tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.functions.temporal import DAY_NAMES
from leakscan.operators.quantiles import exact_quantiles
from leakscan.operators.lookup import bounded_lookup

# The band in which a class of four counts as balanced, and the ratio from which imbalance is reported.
BALANCED_PERCENT = (20, 30)
IMBALANCE_LIMIT = 3.0
WHISKER = 1.5


def _unpivot(row: DataFrame, entries: Sequence[tuple[str, dict[str, Column]]]) -> DataFrame:
    """One output row per entry from a one-row aggregate."""
    structs = [F.struct(F.lit(name).alias("column_name"), *[c.alias(k) for k, c in parts.items()]) for name, parts in entries]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def table_info(df: DataFrame) -> DataFrame:
    """Per column: type and missing count, next to the size of the table. One pass."""
    nulls = [F.count_if(F.col(f.name).isNull()).alias(f"m{i}") for i, f in enumerate(df.schema.fields)]
    totals = df.agg(F.count(F.lit(1)).alias("n"), *nulls)
    entries = [
        (
            f.name,
            {
                "dtype": F.lit(f.dataType.simpleString()),
                "missing": F.col(f"m{i}"),
                "n_rows": F.col("n"),
                "n_columns": F.lit(len(df.columns)),
            },
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return _unpivot(totals, entries)


def missing(df: DataFrame) -> DataFrame:
    """``(column_name, missing, percent)`` of the columns with nulls, most missing first."""
    info = table_info(df).filter(F.col("missing") > 0)
    return info.select("column_name", "missing", (F.col("missing") * 100.0 / F.col("n_rows")).alias("percent")).orderBy(
        F.desc("missing"), "column_name"
    )


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles of numeric columns."""
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [
            F.count(c).alias(f"count{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
        ]
    stats = ("count", "mean", "std", "min", "max")
    basic = _unpivot(df.agg(*aggs), [(c, {s: F.col(f"{s}{i}") for s in stats}) for i, c in enumerate(cols)])
    quartiles = (
        exact_quantiles(df, cols, (0.25, 0.5, 0.75))
        .groupBy(F.col("column").alias("column_name"))
        .agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    )
    return basic.join(quartiles, "column_name", "left")


def distribution(df: DataFrame, col: str) -> DataFrame:
    """``(value, n, percent)``, most frequent first. The total is a scalar subquery over the same counts."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / total).orderBy(F.desc("n"), "value")


def balance_flags(df: DataFrame, col: str) -> DataFrame:
    """Distribution with a flag for classes inside the balanced band."""
    return distribution(df, col).withColumn("balanced", F.col("percent").between(*BALANCED_PERCENT))


def imbalance(df: DataFrame, col: str) -> DataFrame:
    """Largest and smallest class, their ratio, and whether it is high enough to warn."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"))
    ratio = F.col("largest") / F.col("smallest")
    return row.select("largest", "smallest", ratio.alias("ratio"), (ratio > IMBALANCE_LIMIT).alias("imbalanced"))


def cardinality(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """``(column_name, n_distinct)``; nulls do not count."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*[count(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    return _unpivot(row, [(c, {"n_distinct": F.col(f"d{i}")}) for i, c in enumerate(cols)])


#: Buckets of a distinct-count sketch as a power of two: 2**14 hold a relative standard error of some 0.6 percent.
SKETCH_POWER = 14


def distinct_sketches(df: DataFrame, cols: Sequence[str], power: int = SKETCH_POWER) -> DataFrame:
    """``(column_name, n_rows, n_missing, sketch)``: what a profile keeps of a part of a table to count values over all parts.

    One pass, merged map-side; a sketch is bounded by ``power``, whatever the number of rows. Values are told apart as text.
    """
    aggs = []
    for i, c in enumerate(cols):
        aggs += [
            F.count(F.lit(1)).alias(f"n{i}"),
            F.count_if(F.col(c).isNull()).alias(f"m{i}"),
            F.hll_sketch_agg(F.col(c).cast("string"), power).alias(f"s{i}"),
        ]
    fields = {"n_rows": "n", "n_missing": "m", "sketch": "s"}
    return _unpivot(df.agg(*aggs), [(c, {f: F.col(f"{k}{i}") for f, k in fields.items()}) for i, c in enumerate(cols)])


def merged_cardinality(sketches: DataFrame) -> DataFrame:
    """``(column_name, n_rows, n_missing, n_distinct)`` over the stored sketches of all parts; no row of the parts is read again.

    A value found in several parts counts once. Parts may have been sketched with different powers; the least one holds.
    """
    return sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_missing").alias("n_missing"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))).alias("n_distinct"),
    )


def pii_prevalence(df: DataFrame, pii: str = "pii") -> DataFrame:
    """Rows, rows with personal data, mean count and share of rows per kind, from a detection column."""
    d = F.col(pii)
    kinds = {"card": "cards", "passport": "passports", "inn": "inn", "snils": "snils", "phone": "phones", "email": "emails"}
    flags = {k: F.size(d[f]) > 0 for k, f in kinds.items()}
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(d["has_pii"]).alias("n_with_pii"),
        F.avg(d["pii_count"]).alias("mean_pii"),
        F.avg(d["has_pii"].cast("double")).alias("share_with_pii"),
        *[F.count_if(f).alias(f"n_{k}") for k, f in flags.items()],
        *[F.avg(f.cast("double")).alias(f"share_{k}") for k, f in flags.items()],
    )


def _classes(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(c, i) for i, c in enumerate(order)], f"`{by}` string, position int")


def group_stats(df: DataFrame, by: str, value: str, order: Sequence[str]) -> DataFrame:
    """Size, mean, median and maximum per class in a fixed class order; classes without rows are kept."""
    wanted = df.filter(F.col(by).isin(*order))
    basic = wanted.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    medians = exact_quantiles(wanted, [value], [0.5], by=[by]).select(by, F.col("value").alias("median"))
    return (
        _classes(df, by, order)
        .join(basic, by, "left")
        .join(medians, by, "left")
        .select(by, "position", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean", "median", "max")
        .orderBy("position")
    )


def five_number(df: DataFrame, by: str, value: str) -> DataFrame:
    """Box-plot numbers per class: quartiles, whisker ends within 1.5 IQR, and outliers beyond them."""
    quartiles = (
        exact_quantiles(df, [value], [0.25, 0.5, 0.75], by=[by])
        .groupBy(F.col(by).alias("_by"))
        .agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    )
    v = F.col(value).cast("double")
    spread = F.col("q3") - F.col("q1")
    inside = (v >= F.col("q1") - WHISKER * spread) & (v <= F.col("q3") + WHISKER * spread)
    joined = df.join(bounded_lookup(quartiles), F.col(by).eqNullSafe(F.col("_by")))
    return joined.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def hourly(df: DataFrame, by: str, ts: str, pivot: bool = False) -> DataFrame:
    """Counts per class and hour of day; ``pivot`` gives one column per hour."""
    keyed = df.withColumn("hour", F.hour(ts)).filter(F.col("hour").isNotNull())
    if pivot:
        return keyed.groupBy(by).pivot("hour", list(range(24))).count()
    return keyed.groupBy(by, "hour").agg(F.count(F.lit(1)).alias("n"))


def weekday_counts(df: DataFrame, by: str, ts: str) -> DataFrame:
    """Counts per class and weekday (Monday is 0) with the day's short name."""
    counts = (
        df.withColumn("day_of_week", F.weekday(ts))
        .filter(F.col("day_of_week").isNotNull())
        .groupBy(by, "day_of_week")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return counts.withColumn("day_name", F.get(names, F.col("day_of_week")))

"""Validation and selection of records."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Request record, in field order.
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("user_email", T.StringType()),
        T.StructField("recipient_email", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("attachment_names", T.ArrayType(T.StringType())),
        T.StructField("attachment_types", T.ArrayType(T.StringType())),
        T.StructField("attachment_sizes", T.ArrayType(T.LongType())),
        T.StructField("timestamp", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("user_role", T.StringType()),
    ]
)
CORRUPT = "_corrupt_record"
# The same with the column in which the reader keeps records that do not fit.
MARKED_REQUEST_SCHEMA = T.StructType([*REQUEST_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])

# Required fields and the length limits of two of them.
REQUIRED_FIELDS = ("user_email", "recipient_email", "subject", "body", "timestamp")
LENGTH_LIMITS = {"subject": (1, 500), "body": (1, 10_000)}


def reject_reason(df: DataFrame) -> Column:
    """First rule a record breaks, null for a valid one.

    A field of the wrong type shows up as a malformed record when the reader keeps ``_corrupt_record``.
    """
    tests: list[tuple[Column, str]] = []
    if CORRUPT in df.columns:
        tests.append((F.col(CORRUPT).isNotNull(), "malformed record"))
    for name in REQUIRED_FIELDS:
        tests.append((F.col(name).isNull(), f"{name}: missing"))
    for name, (low, high) in LENGTH_LIMITS.items():
        tests.append((F.length(name) < low, f"{name}: too short"))
        tests.append((F.length(name) > high, f"{name}: too long"))
    expr = F.when(tests[0][0], tests[0][1])
    for test, reason in tests[1:]:
        expr = expr.when(test, reason)
    return expr


def with_reject_reason(df: DataFrame) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(df))


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits records into valid ones and rejected ones with their reason."""
    checked = with_reject_reason(df)
    valid = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, checked.filter(F.col("reject_reason").isNotNull())


def select_like(df: DataFrame, *fragments: str, numeric: bool = False) -> DataFrame:
    """Columns whose lower-cased name holds any fragment, or, with ``numeric``, the numeric ones."""
    names = [
        f.name
        for f in df.schema.fields
        if any(part in f.name.lower() for part in fragments) or (numeric and isinstance(f.dataType, T.NumericType))
    ]
    return df.select(*names)


def where_class(df: DataFrame, **values: str) -> DataFrame:
    """Rows whose columns equal the given values; the filter reaches the scan."""
    return df.filter(reduce(and_, (F.col(c) == v for c, v in values.items())))


def errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows whose prediction differs from the truth; a null on one side only is a difference."""
    return df.filter(~F.col(actual).eqNullSafe(F.col(predicted)))


def any_null(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with a null in any of the columns."""
    return df.filter(reduce(or_, (F.col(c).isNull() for c in cols)))


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """First ``n`` rows in a stated order (physical order means nothing in a distributed table)."""
    if not order:
        raise ValueError("head needs an order")
    return df.orderBy(*order).limit(n)

"""Persistence of vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.operators.vectors import vector_width


def save_vectors(df: DataFrame, path: str, mode: str = "overwrite", vector: str = "embedding") -> None:
    """Vectors and metadata are columns of one Parquet table; the write fails if their widths differ."""
    width = F.size(vector)
    one = df.filter(F.col(vector).isNotNull()).select(width.alias("width")).first()
    if one is not None:
        wrong = F.raise_error(F.lit(f"vectors of different widths in one table; expected {one['width']}"))
        df = df.withColumn(vector, F.when(F.col(vector).isNull() | (width == one["width"]), F.col(vector)).otherwise(wrong))
    df.write.mode(mode).parquet(path)


def load_vectors(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """The table, after checking that its vectors have the expected width."""
    df = spark.read.parquet(path)
    width = vector_width(df)
    if dimension is not None and width is not None and width != dimension:
        raise ValueError(f"vector dimension {width} does not match expected dimension {dimension}")
    return df

"""Parallelism of CPU-heavy stages over input with few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartitions by key if the scan gives fewer tasks than there are cores, else leaves the plan alone.

    Pattern matching and tokenising cost far more than moving the text once, and a small file is a single split. Large
    input has more splits than cores and is never shuffled here. Hashing by key keeps a retried task repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if _tasks(df) >= cores else df.repartition(cores, *keys)


def _tasks(df: DataFrame) -> int:
    """Tasks of the plan as it stands. Without adaptive execution for the moment: that would run exchanges to tell."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    try:
        conf.set(key, "false")
        return df.select("*").rdd.getNumPartitions()
    finally:
        conf.set(key, before)

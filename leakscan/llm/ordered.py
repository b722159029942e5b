"""Rows next to each other in a total order, without ranking all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_order(df: DataFrame, keys: list[str], long: str) -> DataFrame:
    """Range partitions in the order of ``keys``, each sorted, with the number ``part`` of the partition.

    Rows equal in all keys are ordered by a 64-bit hash of the column ``long``, then by the column itself. Ranges are drawn on
    keys and hash: Spark samples what it draws ranges on to the driver, and long values have no business there.

    Neighbours meet in one task but for the last and first rows of adjacent partitions, of which there is one each. The
    number of partitions is the session's number of shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, F.xxhash64(long)]
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by, long).withColumn("part", F.spark_partition_id())


def following(parts: DataFrame, wrap: bool = False) -> DataFrame:
    """part, next_part: the next partition that has rows; after the last null, or with ``wrap`` the first.

    ``parts``: one narrow row per partition, hence one task.
    """
    order = Window.orderBy("part")
    after = F.lead("part").over(order)
    return parts.select("part", (F.coalesce(after, F.first("part").over(order)) if wrap else after).alias("next_part"))

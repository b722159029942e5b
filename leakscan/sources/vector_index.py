"""A stored index for exact vector search.

A folder holds ``rows`` (Parquet, partitioned by pivot, with all metadata), ``centres`` (the pivots), ``sizes`` (radius and number of rows per
pivot and append) and ``manifest`` (dimension and names). Opening it reads the last three, never the rows. An append deals new
rows to the pivots there are and adds files; none is rewritten. Sizes are written before rows, so a search never misses rows
of an append that was cut off, and running that append again under its ``batch`` replaces it.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.operators.lookup import bounded_lookup
from leakscan.operators.pivots import Pivots, choose_pivots, deal, pivot_sizes, pivots_of, search
from leakscan.session import materialise


def build_vector_index(df: DataFrame, path: str, id_col: str = "id", vector: str = "embedding") -> VectorIndex:
    """Writes an index over a vector table; rows with a null id or vector are left out."""
    spark, centres = df.sparkSession, choose_pivots(df, id_col, vector)
    info = json.dumps({"dimension": centres.shape[1] if len(centres) else 0, "id": id_col, "vector": vector})
    listed = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame([(info,)], "info string").write.parquet(f"{path}/manifest")
    spark.createDataFrame(listed, "pivot int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    _add(df, path, centres, id_col, vector, "build")
    return VectorIndex(spark, path)


def _add(df: DataFrame, path: str, centres: np.ndarray, id_col: str, vector: str, batch: str) -> None:
    dealt = materialise(deal(df, centres, id_col, vector), "index-rows")
    pivot_sizes(dealt).write.mode("overwrite").parquet(f"{path}/sizes/batch={batch}")
    # one pivot's rows of a batch go to few files, however many tasks dealt them
    dealt.repartition(F.col("pivot"), F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("pivot").parquet(
        f"{path}/rows/batch={batch}"
    )


class VectorIndex:
    """An index as it is stored now."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        info = json.loads(spark.read.parquet(f"{path}/manifest").first()["info"])
        self.dimension, self.id_col, self.vector = info["dimension"], info["id"], info["vector"]
        centres = sorted(spark.read.parquet(f"{path}/centres").collect())
        self._centres = np.array([r["centre"] for r in centres], dtype=float).reshape(len(centres), self.dimension)

    def sizes(self) -> DataFrame:
        """``(batch, pivot, radius, n)``."""
        return self.spark.read.schema("batch string, pivot int, radius double, n long").parquet(f"{self.path}/sizes")

    def pivots(self) -> Pivots:
        return pivots_of(self._centres, self.sizes())

    def rows(self) -> DataFrame:
        """Stored rows; a filter on ``pivot`` prunes folders."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def append(self, df: DataFrame, batch: str) -> None:
        """Adds rows under the name of a batch; the same name again replaces that batch and nothing else."""
        if not len(self._centres):
            raise ValueError("an index built over no rows has no pivots; build it anew")
        _add(df, self.path, self._centres, self.id_col, self.vector, batch)

    def search(self, queries: DataFrame, k: int = 5, query_id: str = "query_id", vector: str = "embedding", metadata: bool = False) -> DataFrame:
        """``query_id, id, distance, similarity, rank``, and with ``metadata`` the stored columns of each neighbour."""
        found, _ = self.search_counted(queries, k, query_id, vector)
        if not metadata or "row" not in self.rows().columns:
            return found
        hits = bounded_lookup(materialise(found.withColumnRenamed("id", "_hit"), "hits"), stored=True)
        return self.rows().join(hits, F.col("id") == F.col("_hit")).select(*found.columns, "row.*")

    def search_counted(self, queries: DataFrame, k: int = 5, query_id: str = "query_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
        """The hits, and how many rows each query was compared with."""
        pivots = self.pivots()
        if not pivots.n.sum():
            none = queries.limit(0).select(F.col(query_id).alias("query_id"))
            empty = none.selectExpr("query_id", "NULL AS id", "0D AS distance", "0D AS similarity", "0 AS rank")
            return empty, none.selectExpr("query_id", "0L AS compared")
        return search(self.rows(), pivots, queries, k, query_id, vector)

"""Vector tables: embedding, appending, statistics, clusters and a two-dimensional view."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from leakscan.operators.vocabulary import with_terms

DIMENSION = 384


def embed_text(df: DataFrame, text_col: str, dim: int = DIMENSION, into: str = "embedding") -> DataFrame:
    """Adds a unit vector of hashed uni- and bigram counts; text without a word gives the zero vector.

    Nothing is fitted, so a query and a corpus embedded apart, or a stream, meet in the same space.
    """
    terms, counted, scaled = f"_{into}_terms", f"_{into}_tf", f"_{into}_unit"
    out = with_terms(df, text_col, into=terms)
    out = HashingTF(numFeatures=dim, inputCol=terms, outputCol=counted).transform(out)
    out = Normalizer(p=2.0, inputCol=counted, outputCol=scaled).transform(out)
    return out.withColumn(into, vector_to_array(scaled, "float32")).drop(terms, counted, scaled)


def vector_width(df: DataFrame, vector: str = "embedding") -> int | None:
    """Width shared by all vectors, None for an empty table; differing widths are an error."""
    row = df.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if row["low"] != row["high"]:
        raise ValueError(f"vectors of width {row['low']} and {row['high']} in one table")
    return row["low"]


def add_vectors(base: DataFrame, new: DataFrame, vector: str = "embedding") -> DataFrame:
    """Appends rows to a vector table. Metadata travels in the row; a missing column becomes null."""
    have, got = vector_width(base, vector), vector_width(new, vector)
    if have is not None and got is not None and have != got:
        raise ValueError(f"vector dimension {got} does not match table dimension {have}")
    return base.unionByName(new, allowMissingColumns=True)


def vector_stats(df: DataFrame, vector: str = "embedding", metadata: str | None = None) -> DataFrame:
    """Number of vectors, their dimension and the number of rows with metadata."""
    return df.agg(
        F.count(vector).alias("total_vectors"),
        F.max(F.size(vector)).alias("dimension"),
        F.count(metadata or F.lit(1)).alias("metadata_count"),
    )


def kmeans_model(
    df: DataFrame, k: int = 10, seed: int = 42, n_init: int = 10, vector: str = "embedding", parallelism: int = 4
) -> KMeansModel:
    """The k-means model of lowest cost among ``n_init`` starts with consecutive seeds.

    Starts are independent, so several run at once over the same persisted vectors.
    """
    data = df.select(array_to_vector(F.col(vector)).alias("features")).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(start: int) -> KMeansModel:
        return KMeans(k=k, seed=seed + start, featuresCol="features", predictionCol="cluster").fit(data)

    try:
        data.count()
        with ThreadPoolExecutor(parallelism) as pool:
            models = list(pool.map(inheritable_thread_target(df.sparkSession)(fit), range(n_init)))
    finally:
        data.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def cluster(df: DataFrame, k: int = 10, seed: int = 42, n_init: int = 10, vector: str = "embedding") -> DataFrame:
    """Adds the ``cluster`` of each vector."""
    model = kmeans_model(df, k, seed, n_init, vector)
    assigned = model.transform(df.withColumn("features", array_to_vector(F.col(vector))))
    return assigned.drop("features")


def cluster_sizes(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    return df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n")).orderBy(cluster_col)


def cluster_mix(df: DataFrame, kind: str, cluster_col: str = "cluster") -> DataFrame:
    """Rows per cluster and kind."""
    return df.groupBy(cluster_col, kind).agg(F.count(F.lit(1)).alias("n"))


def project_2d(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """All rows with the two leading principal components ``x`` and ``y``; ``sample_n`` first for a part of them."""
    chosen = df.withColumn("features", array_to_vector(F.col(vector)))
    model = PCA(k=2, inputCol="features", outputCol="projected").fit(chosen)
    xy = vector_to_array("projected")
    return model.transform(chosen).withColumn("x", xy[0]).withColumn("y", xy[1]).drop("features", "projected", vector)

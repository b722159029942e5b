"""Vector search, statistics and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.catalog.tables import SEED, documents, table
from leakscan.functions.vector import cosine
from leakscan.operators import neighbours
from leakscan.operators import vectors as V
from leakscan.operators.restarts import assign, fit_restarts
from leakscan.plans.similarity import build_index, find_similar, similar_vectors
from leakscan.session import work_path
from leakscan.sources.vector_index import VectorIndex, build_vector_index
from leakscan.sources.vectors import load_vectors, save_vectors

K = 5


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every vector of the table."""
    e = _embeddings(spark, sf_dir)
    hits = neighbours.knn(e, e.withColumnRenamed("vec_id", "query_id"), K, "vec_id")
    return hits.select(
        "query_id",
        "id",
        F.round("distance", 6).alias("distance"),
        F.round("similarity", 6).alias("similarity"),
        F.col("rank").cast("long").alias("rank"),
    )


def knn_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours with their metadata: how often they share the label of the query."""
    e = _embeddings(spark, sf_dir)
    hits = similar_vectors(e, e.select(F.col("vec_id").alias("query_id"), "embedding"), K, "vec_id")
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return (
        hits.join(asked, "query_id")
        .groupBy("query_label", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))
    )


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine similarity of each vector with the one that follows it."""
    e = _embeddings(spark, sf_dir)
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    both = e.join(following, "vec_id")
    return both.select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = V.vector_stats(_embeddings(spark, sf_dir), metadata="label")
    return stats.withColumn("dimension", F.col("dimension").cast("long"))


def vectors_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table appended to itself under new ids, without metadata."""
    e = _embeddings(spark, sf_dir)
    new = e.select((-F.col("vec_id") - 1).alias("vec_id"), "embedding")
    both = V.add_vectors(e, new)
    return both.select(
        "vec_id", F.size("embedding").cast("long").alias("dimension"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), "label"
    )


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cluster_sizes(_embeddings(spark, sf_dir), "label")


def cluster_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored cluster against the sign of the first component."""
    kind = F.when(F.col("embedding")[0] > 0, "positive").otherwise("other")
    return V.cluster_mix(_embeddings(spark, sf_dir).withColumn("kind", kind), "kind", "label")


def vectors_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "vectors")
    save_vectors(_embeddings(spark, sf_dir), path)
    back = load_vectors(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return back.select("vec_id", "label", F.round(total, 4).alias("total"))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most like each benchmark passage."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    hits = find_similar(documents(spark, sf_dir), asked, K, "doc_id", "text")
    return hits.select("query_id", "rank", "doc_id", "lang", "source", "distance", "similarity")


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the stored vector table of all documents."""
    path = work_path(spark, "index")
    build_index(documents(spark, sf_dir), "text", path)
    return V.vector_stats(load_vectors(spark, path, V.DIMENSION), metadata="doc_id")


def _stored_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """An index over the even ids to which the odd ones have been appended, one of them twice under one name."""
    e, path = _embeddings(spark, sf_dir), work_path(spark, "vector-index")
    index = build_vector_index(e.filter("vec_id % 2 = 0"), path, "vec_id")
    for batch, rest in (("three", 3), ("one", 1), ("three", 3)):
        index.append(e.filter(F.col("vec_id") % 4 == rest), batch)
    return VectorIndex(spark, path)


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every vector, found in a stored index that has grown by appends."""
    asked = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    hits = _stored_index(spark, sf_dir).search(asked, K, metadata=True)
    return hits.select(
        "query_id",
        "id",
        F.round("distance", 6).alias("distance"),
        F.round("similarity", 6).alias("similarity"),
        F.col("rank").cast("long").alias("rank"),
        "label",
    )


def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per batch of the stored index, and whether all of them lie within the radius that its sizes state."""
    index = _stored_index(spark, sf_dir)
    stated = index.sizes().groupBy("batch", "pivot").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
    there = index.rows().groupBy("batch", "pivot").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("rows"))
    return (
        stated.join(there, ["batch", "pivot"], "full")
        .groupBy("batch")
        .agg(F.sum("rows").alias("n"), F.bool_and((F.col("n") == F.col("rows")) & (F.col("gap") <= F.col("radius"))).alias("as_stated"))
    )


def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = V.cluster(_embeddings(spark, sf_dir), k=10, seed=SEED)
    return V.cluster_mix(clustered, "label")


def kmeans_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten restarts updated together: rows assigned, and whether the kept centres are the cheapest and cost what they state."""
    vectors = _embeddings(spark, sf_dir)
    fitted = fit_restarts(vectors, k=10, seed=SEED)
    nearest = F.lit(None).cast("double")
    for c in fitted.centres:
        gaps = F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b))
        nearest = F.least(nearest, F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x))
    told = assign(vectors, fitted.centres).agg(
        F.count("cluster").alias("n"), (F.count_distinct("cluster") <= 10).alias("few_clusters"), F.sum(nearest).alias("cost")
    )
    stated = F.abs(F.col("cost") - fitted.cost) <= 1e-6 * fitted.cost
    return told.select("n", "few_clusters", (stated & F.lit(fitted.cost <= min(fitted.costs))).alias("cheapest"))


def project_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.project_2d(_embeddings(spark, sf_dir))


_KNN = f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id AS id, c.label AS label,
        array_distance(q.v, c.v) * array_distance(q.v, c.v) AS distance FROM e q CROSS JOIN e c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM d),
t AS (SELECT * FROM r WHERE rank <= {K})"""

QUERIES = {
    "knn": knn,
    "knn_similar": knn_similar,
    "cosine_pairs": cosine_pairs,
    "vector_stats": vector_stats,
    "vectors_append": vectors_append,
    "cluster_sizes": cluster_sizes,
    "cluster_mix": cluster_mix,
    "vectors_roundtrip": vectors_roundtrip,
    "similar_documents": similar_documents,
    "index_build": index_build,
    "index_search": index_search,
    "index_sizes": index_sizes,
    "kmeans": kmeans,
    "kmeans_restarts": kmeans_restarts,
    "project_2d": project_2d,
}

ORACLES = {
    "knn": f"""{_KNN} SELECT query_id, id, round(distance, 6) AS distance, round(exp(-distance / 10), 6) AS similarity,
  rank::BIGINT AS rank FROM t""",
    "knn_similar": f"""{_KNN} SELECT query_label, label, count(*) AS n, round(avg(exp(-distance / 10)), 6) AS mean_similarity
FROM t GROUP BY ALL""",
    "index_search": f"""{_KNN} SELECT query_id, id, round(distance, 6) AS distance, round(exp(-distance / 10), 6) AS similarity,
  rank::BIGINT AS rank, label FROM t""",
    "index_sizes": """SELECT CASE vec_id % 4 WHEN 1 THEN 'one' WHEN 3 THEN 'three' ELSE 'build' END AS batch, count(*) AS n, true AS as_stated
FROM embeddings GROUP BY ALL""",
    "cosine_pairs": """WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings)
SELECT a.vec_id, round(array_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""",
    "vector_stats": """SELECT count(embedding) AS total_vectors, max(len(embedding))::BIGINT AS dimension,
  count(label) AS metadata_count FROM embeddings""",
    "vectors_append": """SELECT vec_id, len(embedding)::BIGINT AS dimension, round(embedding[1]::DOUBLE, 6) AS first, label FROM embeddings
UNION ALL SELECT -vec_id - 1, len(embedding)::BIGINT, round(embedding[1]::DOUBLE, 6), NULL::INT FROM embeddings""",
    "kmeans_restarts": "SELECT count(embedding) AS n, true AS few_clusters, true AS cheapest FROM embeddings",
    "cluster_sizes": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "cluster_mix": """SELECT label, CASE WHEN embedding[1] > 0 THEN 'positive' ELSE 'other' END AS kind, count(*) AS n
FROM embeddings GROUP BY ALL""",
    "vectors_roundtrip": "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
}

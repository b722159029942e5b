"""Similar incidents: embed, find neighbours, bring back the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.operators.neighbours import knn
from leakscan.operators.vectors import DIMENSION, embed_text
from leakscan.operators.lookup import bounded_lookup
from leakscan.session import materialise
from leakscan.sources.vectors import save_vectors


def build_index(df: DataFrame, text_col: str, path: str, dim: int = DIMENSION) -> None:
    """Embeds a text column and writes the vector table with all columns as metadata."""
    save_vectors(embed_text(df, text_col, dim), path)


def similar_vectors(
    corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", query_id: str = "query_id", vector: str = "embedding"
) -> DataFrame:
    """Neighbours of each query vector with all corpus columns, distance, similarity and rank.

    The hits, k per query, are looked up from the corpus side: while they are few they are broadcast and the corpus is
    filtered where it lies.
    """
    found = knn(corpus, queries, k, id_col, query_id, vector).withColumnRenamed("id", "_hit")
    hits = bounded_lookup(materialise(found, "hits"), stored=True)  # the search runs once, however many hits there are
    metadata = corpus.drop(vector)
    return metadata.join(hits, F.col("_hit") == F.col(id_col)).drop("_hit")


def find_similar(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "id",
    text_col: str = "description",
    query_id: str = "query_id",
    query_text: str = "query_text",
    dim: int = DIMENSION,
) -> DataFrame:
    """Incidents most like each query text. A corpus that already has an ``embedding`` column keeps it."""
    embedded = corpus if "embedding" in corpus.columns else embed_text(corpus, text_col, dim)
    asked = embed_text(queries.select(query_id, query_text), query_text, dim)
    return similar_vectors(embedded, asked, k, id_col, query_id)


def find_similar_text(
    spark: SparkSession, corpus: DataFrame, text: str, k: int = 5, id_col: str = "id", text_col: str = "description"
) -> DataFrame:
    """Incidents most like one text."""
    query = spark.createDataFrame([(0, text)], "query_id int, query_text string")
    return find_similar(corpus, query, k, id_col, text_col).drop("query_id")

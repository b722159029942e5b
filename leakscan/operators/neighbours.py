"""Exact k nearest neighbours by squared L2 distance.

Queries that fit a checked memory bound go to every task, which keeps the k best corpus rows per query while it reads
its partition: the corpus is not shuffled and no pair leaves a task unless it is among the k best there. More queries
than that are cut into blocks against blocks of the corpus, one block pair per group, each within the same bound.
Distances come from one matrix product per batch; rows near the k-th best are measured again by plain differences, so
that equal vectors get equal distances and ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leakscan.functions.vector import similarity
from leakscan.operators.parallel import spread

MAX_QUERY_BYTES = 64 << 20
_BATCH_ROWS = 4096
_PAIRS_PER_STEP = 4 << 20


def _best_keeper(k: int) -> Callable:
    """A function that merges one corpus block into the k best of a query block.

    Built as a closure so that it travels to the executors by value.
    """

    def keep(query_vectors, best, ids, vectors):
        """``best`` is None or three aligned arrays: query position, corpus id, distance."""
        if vectors.shape[1] != query_vectors.shape[1]:
            raise ValueError(f"corpus vectors of width {vectors.shape[1]}, query vectors of width {query_vectors.shape[1]}")
        found_q, found_id, found_d = ([], [], []) if best is None else ([best[0]], [best[1]], [best[2]])
        n_queries = len(query_vectors)
        kth = np.full(n_queries, np.inf)
        if best is not None:
            full = np.bincount(best[0], minlength=n_queries) >= k
            worst = np.full(n_queries, -np.inf)
            np.maximum.at(worst, best[0], best[2])
            kth[full] = worst[full]
        norms = np.einsum("ij,ij->i", vectors, vectors)
        query_norms = np.einsum("ij,ij->i", query_vectors, query_vectors)
        step = max(1, _PAIRS_PER_STEP // max(1, len(vectors)))
        for start in range(0, n_queries, step):
            block = query_vectors[start : start + step]
            scale = query_norms[start : start + step]
            rough = scale[:, None] + norms[None, :] - 2.0 * (block @ vectors.T)
            slack = 1e-9 * (1.0 + scale + norms.max())
            limit = kth[start : start + step]
            if len(vectors) > k:
                limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
            rows, cols = np.nonzero(rough <= (limit + slack)[:, None])
            if len(rows):
                gap = block[rows] - vectors[cols]
                found_q.append(rows + start)
                found_id.append(ids[cols])
                found_d.append((gap * gap).sum(axis=1))
        if not found_q:
            return None
        q, i, d = np.concatenate(found_q), np.concatenate(found_id), np.concatenate(found_d)
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        first = np.searchsorted(q, q, side="left")
        kept = np.arange(len(q)) - first < k
        return q[kept], i[kept], d[kept]

    return keep


def _reader() -> Callable:
    """A function that takes ids and vectors of an Arrow table or batch as arrays; a closure, as above."""

    def read(batch, id_col):
        import pyarrow as pa

        table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        ids = table.column(id_col).to_numpy()
        if ids.dtype == object:
            ids = ids.astype(str)
        lists = table.column("v").combine_chunks()
        flat = np.asarray(lists.flatten(), dtype=np.float64)
        width = len(flat) // len(ids) if len(ids) else 0
        if len(ids) and not (lists.value_lengths().to_numpy() == width).all():
            raise ValueError("vectors of different widths in one table")
        return ids, flat.reshape(len(ids), width)

    return read


def _field(df: DataFrame, name: str, alias: str) -> T.StructField:
    return T.StructField(alias, df.schema[name].dataType)


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "id",
    query_id: str = "query_id",
    vector: str = "embedding",
    max_query_bytes: int = MAX_QUERY_BYTES,
) -> DataFrame:
    """``(query_id, id, distance, similarity, rank)``: the min(k, corpus size) nearest rows of each query.

    Ids must identify rows; rows with a null vector or a null id neither ask nor are neighbours. An empty corpus gives no rows.
    """
    corpus = corpus.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    queries = queries.filter(F.col(vector).isNotNull() & F.col(query_id).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(vector).alias("v")
    )
    schema = T.StructType(
        [_field(queries, "query_id", "query_id"), _field(corpus, "id", "id"), T.StructField("distance", T.DoubleType())]
    )
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"]:
        partial = corpus.sparkSession.createDataFrame([], schema)
    elif size["n"] * size["dim"] * 8 <= max_query_bytes:
        partial = _scan_corpus(corpus, queries, k, schema)
    else:
        partial = _block_pairs(corpus, queries, k, schema, max(1, max_query_bytes // (8 * size["dim"])), size["n"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    top = partial.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.select("query_id", "id", "distance", similarity(F.col("distance")).alias("similarity"), "rank")


def _scan_corpus(corpus: DataFrame, queries: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    context = corpus.sparkSession.sparkContext
    keep, read = _best_keeper(k), _reader()
    query_ids, vectors = read(queries.toArrow(), "query_id")  # within max_query_bytes
    asked = context.broadcast((query_ids, vectors))
    layout = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_vectors = asked.value
        best = None
        for batch in batches:
            for start in range(0, batch.num_rows, _BATCH_ROWS):
                ids, vectors = read(batch.slice(start, _BATCH_ROWS), "id")
                best = keep(query_vectors, best, ids, vectors)
        if best is not None:
            columns = (query_ids[best[0]], best[1], best[2])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, layout)], schema=layout)

    return spread(corpus, "id").mapInArrow(scan, schema)


def _block_pairs(
    corpus: DataFrame, queries: DataFrame, k: int, schema: T.StructType, rows_per_block: int, n_queries: int
) -> DataFrame:
    """Every query block meets every corpus block once; a group holds one block of each."""
    query_blocks = math.ceil(n_queries / rows_per_block)
    corpus_blocks = max(1, math.ceil(corpus.count() / rows_per_block))
    block = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    left = queries.withColumn("qb", block("query_id", query_blocks)).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1)))
    )
    right = corpus.withColumn("cb", block("id", corpus_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    keep, read = _best_keeper(k), _reader()
    layout = to_arrow_schema(schema)

    def meet(asked: pa.Table, stored: pa.Table) -> pa.Table:
        best = None
        if asked.num_rows and stored.num_rows:
            query_ids, query_vectors = read(asked, "query_id")
            for start in range(0, stored.num_rows, _BATCH_ROWS):
                ids, vectors = read(stored.slice(start, _BATCH_ROWS), "id")
                best = keep(query_vectors, best, ids, vectors)
        columns = ([], [], []) if best is None else (query_ids[best[0]], best[1], best[2])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, layout)], schema=layout)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, schema)

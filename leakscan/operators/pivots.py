"""Exact nearest neighbours that skip what the triangle inequality rules out.

A corpus is dealt to pivots, vectors of its own: each row goes to its nearest pivot and keeps its distance to it, and each pivot knows the
radius of its rows. A query visits pivots in the order of their distance, a few at first and more with each round. After a
round its k-th best distance is the bound, which only falls: a pivot is skipped if query and rows must lie further apart
than that (distance to the pivot less the radius), and within a pivot only rows are compared whose distance to the pivot differs
from the query's by no more. What is skipped cannot be among the k best, so the result is that of comparing all pairs.

Neighbouring pivots are bundled up to a block of rows, so that a query's vector travels once for each bundle that it visits and
not once for each pivot. Queries and rows meet by (bundle, block of rows, block of queries); blocks hold a bounded number and
bounded bytes of either, so a pivot that draws a third of the corpus or of the queries is shared out, and a task's memory does not
grow with the tables. Only pivots, bounded in number, reach the driver or are broadcast.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leakscan.functions.vector import similarity
from leakscan.operators.neighbours import _reader
from leakscan.session import materialise

# Functions travel to the executors by value, so that these need not have the package; broadcasts hold arrays only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most pivots of an index; most rows and queries of a block; factor by which the pivots that a round visits grow.
MAX_PIVOTS, BLOCK_ROWS, BLOCK_QUERIES, FAN = 512, 40_000, 40_000, 4
#: Most bytes of the vectors of a block; rows below which smaller blocks would not pay; bytes of a batch of asked pivots.
BLOCK_BYTES, LEAST_BLOCK, ASKED_BYTES = 24 << 20, 2_000, 16 << 20
#: Queries that are compared with a pivot's rows at a time, nearest first; pairs whose distances are held at a time.
CHUNK, PAIRS = 256, 2 << 20
#: Distances that differ by less than this share may be equal before rounding.
_SHADE = 1e-9


@dataclass
class Pivots:
    """Centres, the radius of their rows and the number of these; small enough for the driver and for every task."""

    centres: np.ndarray
    radius: np.ndarray
    n: np.ndarray


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Vectors x pivots; measured by differences, since the bounds must hold to the last digits."""
    out = np.empty((len(vectors), len(centres)))
    for i, c in enumerate(centres):
        gap = vectors - c
        out[:, i] = np.sqrt((gap * gap).sum(axis=1))
    return out


def choose_pivots(df: DataFrame, id_col: str, vector: str, most: int = MAX_PIVOTS) -> np.ndarray:
    """About the square root of the number of rows, drawn by a hash of the id, distinct."""
    rows = df.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    many = min(most, max(1, math.isqrt(rows.count())))
    drawn = rows.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(many).select(vector).collect()
    return np.unique(np.array([r[0] for r in drawn], dtype=float), axis=0) if drawn else np.zeros((0, 0))


def deal(df: DataFrame, centres: np.ndarray, id_col: str, vector: str, metadata: bool = True) -> DataFrame:
    """``pivot``, ``gap`` (distance to it), ``id``, ``v`` and, with ``metadata``, the other columns in a struct ``row``."""
    others = [c for c in df.columns if c not in (id_col, vector)] if metadata else []
    rows = df.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"),
        *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []),
    )
    schema = T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("gap", T.DoubleType()), *rows.schema.fields])
    shared, read = df.sparkSession.sparkContext.broadcast(centres), _reader()

    def assign(batches):
        for b in batches:
            _, vectors = read(b, "id")
            if len(vectors) and vectors.shape[1] != shared.value.shape[1]:
                raise ValueError(f"vectors of width {vectors.shape[1]} in an index of width {shared.value.shape[1]}")
            far = _distances(vectors, shared.value)
            pivot = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(pivot)), pivot]), *b.columns], names=schema.names
            )

    return rows.mapInArrow(assign, schema)


def pivot_sizes(dealt: DataFrame) -> DataFrame:
    """``(pivot, radius, n)``."""
    return dealt.groupBy("pivot").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))


def pivots_of(centres: np.ndarray, sizes: DataFrame) -> Pivots:
    """From sizes of one or more parts of a corpus."""
    radius, n = np.full(len(centres), -np.inf), np.zeros(len(centres), dtype=np.int64)
    for r in sizes.groupBy("pivot").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect():  # a row per pivot
        radius[r["pivot"]], n[r["pivot"]] = r["radius"], r["n"]
    return Pivots(centres, radius, n)


def _bundles(pivots: Pivots, most: int) -> np.ndarray:
    """A bundle for each pivot: neighbouring pivots of at most ``most`` rows together, a larger pivot alone."""
    out, left = np.zeros(len(pivots.n), dtype=np.int32), set(range(len(pivots.n)))
    at, bundle, held = 0, 0, 0
    while left:
        if held and held + pivots.n[at] > most:
            bundle, held = bundle + 1, 0
        out[at], held = bundle, held + pivots.n[at]
        left.remove(at)
        if left:
            rest = np.array(sorted(left))
            at = int(rest[_distances(pivots.centres[rest], pivots.centres[at : at + 1]).argmin()])
    return out


def _ask(queries: DataFrame, pivots: Pivots, bundles: np.ndarray, visited: int, upto: int) -> DataFrame:
    """``(query_id, v, bound, bundle, pivots, far)``: the pivots number ``visited`` to ``upto`` of each query that may hold a
    neighbour, by bundle, and how far they are."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots.centres, pivots.radius, pivots.n, bundles))
    more = [("bundle", T.IntegerType()), ("pivots", T.ArrayType(T.IntegerType())), ("far", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*queries.schema.fields, *(T.StructField(n, t) for n, t in more)])
    step = max(1, ASKED_BYTES // (64 + 8 * pivots.centres.shape[1]))
    read = _reader()

    def ask(batches):
        centres, radius, n, bundles = shared.value
        for whole in batches:
            for start in range(0, len(whole), 1024):
                b = whole.slice(start, 1024)
                _, vectors = read(b, "query_id")
                far = _distances(vectors, centres)
                order = np.argsort(far, axis=1, kind="stable")[:, visited:upto]
                bound = b.column("bound").to_numpy(zero_copy_only=False)[:, None]
                near = np.take_along_axis(far, order, axis=1)
                may = (near - radius[order] <= bound + _SHADE * (1 + near)) & (n[order] > 0)
                row, col = np.nonzero(may)
                pivot, near = order[row, col], near[row, col]
                by = np.lexsort((pivot, bundles[pivot], row))
                row, pivot, near = row[by], pivot[by].astype(np.int32), near[by]
                bundle = bundles[pivot]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1])][: len(row)])
                ends = np.r_[first, len(row)]
                for i in range(0, len(first), step):
                    some = first[i : i + step]
                    cuts = ends[i : i + len(some) + 1]
                    at, held = pa.array(row[some]), slice(int(cuts[0]), int(cuts[-1]))
                    offsets = pa.array((cuts - cuts[0]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(c.take(at) for c in b.columns),
                            pa.array(bundle[some]),
                            pa.ListArray.from_arrays(offsets, pa.array(pivot[held])),
                            pa.ListArray.from_arrays(offsets, pa.array(near[held])),
                        ],
                        names=schema.names,
                    )

    return queries.mapInArrow(ask, schema)


def _nearest(k: int):
    """A function that gives the k best rows of each query among those of the pivots that it asks for; a closure, to travel by value."""

    def best_of(found):
        q, row, d, ids = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((ids, d, q))
        q, row, d, ids = q[order], row[order], d[order], ids[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        return q[kept], row[kept], d[kept], ids[kept]

    def nearest(queries, bound, asks, ids, vectors, pivot, gaps):
        """``asks``: position of a query, pivot and distance to it; rows ordered by pivot and gap. Gives best and numbers compared."""
        of, wanted, far = asks
        order = np.lexsort((far, wanted))
        of, wanted, far = of[order], wanted[order], far[order]
        norms, scales = np.einsum("ij,ij->i", vectors, vectors), np.einsum("ij,ij->i", queries, queries)
        found, held, compared = [], 0, np.zeros(len(queries), dtype=np.int64)
        edges = np.flatnonzero(np.r_[True, wanted[1:] != wanted[:-1]])
        for start, end in zip(edges, np.r_[edges[1:], len(wanted)]):
            low, high = np.searchsorted(pivot, wanted[start], side="left"), np.searchsorted(pivot, wanted[start], side="right")
            for c in range(start, end, CHUNK):
                q, f = of[c : min(c + CHUNK, end)], far[c : min(c + CHUNK, end)]
                reach = bound[q] + _SHADE * (1 + f)
                a = low + np.searchsorted(gaps[low:high], (f - reach).min(), side="left")
                b = low + np.searchsorted(gaps[low:high], (f + reach).max(), side="right")
                compared[q] += b - a
                step = max(1, PAIRS // len(q))
                for i in range(a, b, step):
                    window = slice(i, min(i + step, b))
                    rough = scales[q, None] + norms[None, window] - 2.0 * (queries[q] @ vectors[window].T)
                    limit = bound[q] ** 2
                    hits = rough <= (limit + 1e-9 * (1.0 + scales[q] + norms[window].max()))[:, None]
                    if rough.shape[1] > k and hits.sum() > 2 * k * len(q):
                        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
                        hits = rough <= (limit + 1e-9 * (1.0 + scales[q] + norms[window].max()))[:, None]
                    x, y = np.nonzero(hits)
                    for part in range(0, len(x), 100_000):  # equal vectors may all be hits
                        rows, cols = q[x[part : part + 100_000]], y[part : part + 100_000] + i
                        gap = queries[rows] - vectors[cols]
                        found.append((rows, cols, (gap * gap).sum(axis=1), ids[cols]))
                        held += len(rows)
                        if held > PAIRS:
                            found = [best_of(found)]
                            held = len(found[0][0]) // 2
        return (best_of(found) if found else None), compared

    return nearest


def _meet(asked: DataFrame, rows: DataFrame, pivots: Pivots, bundles: np.ndarray, block: int, k: int, schema: T.StructType) -> DataFrame:
    """The k best rows of each query in each block that it meets, and in a row without an id how many it was compared with."""
    waiting = {r["bundle"]: r["count"] for r in asked.groupBy("bundle").count().collect()}  # a row per bundle
    if not waiting:
        return asked.sparkSession.createDataFrame([], schema)
    held = np.bincount(bundles, weights=pivots.n)
    most = min(block, BLOCK_QUERIES)
    sizes = {g: (max(1, math.ceil(held[g] / block)), max(1, math.ceil(c / most))) for g, c in waiting.items()}
    of_bundle = [(g, *sizes[g]) for g in sizes]
    of_pivot = [(p, int(g), *sizes[g]) for p, g in enumerate(bundles.tolist()) if g in sizes and pivots.n[p]]
    spark, counts = asked.sparkSession, "row_blocks int, query_blocks int"
    part = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(F.broadcast(spark.createDataFrame(of_bundle, f"bundle int, {counts}")), "bundle")
    left = left.withColumn("qb", part("query_id", "query_blocks")).withColumn("rb", each("row_blocks"))
    there = rows.filter(F.col("pivot").isin([p for p, *_ in of_pivot])).select("pivot", "gap", "id", "v")  # prunes a stored table
    right = there.join(F.broadcast(spark.createDataFrame(of_pivot, f"pivot int, bundle int, {counts}")), "pivot")
    right = right.withColumn("rb", part("id", "row_blocks")).withColumn("qb", each("query_blocks"))
    nearest, read, layout = _nearest(k), _reader(), to_arrow_schema(schema)

    def meet(asked: pa.Table, stored: pa.Table) -> pa.Table:
        none = pa.Table.from_arrays([pa.array([], f.type) for f in layout], schema=layout)
        if not (asked.num_rows and stored.num_rows):
            return none
        query_ids, queries = read(asked, "query_id")
        stored = stored.sort_by([("pivot", "ascending"), ("gap", "ascending")])
        ids, vectors = read(stored, "id")
        if queries.shape[1] != vectors.shape[1]:
            raise ValueError(f"corpus vectors of width {vectors.shape[1]}, query vectors of width {queries.shape[1]}")
        lists, far = asked.column("pivots").combine_chunks(), asked.column("far").combine_chunks()
        of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        asks = (of, lists.flatten().to_numpy(), far.flatten().to_numpy())
        bound, pivot, gaps = asked.column("bound").to_numpy(), stored.column("pivot").to_numpy(), stored.column("gap").to_numpy()
        best, compared = nearest(queries, bound, asks, ids, vectors, pivot, gaps)
        told = (query_ids, pa.nulls(len(compared), layout.field("id").type), pa.nulls(len(compared), pa.float64()), compared)
        parts = [told] if best is None else [told, (query_ids[best[0]], best[3], best[2], np.zeros(len(best[0]), dtype=np.int64))]
        columns = lambda p: [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(p, layout)]
        return pa.concat_tables([pa.Table.from_arrays(columns(p), schema=layout) for p in parts])

    keys = ("bundle", "rb", "qb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def search(
    rows: DataFrame, pivots: Pivots, queries: DataFrame, k: int = 5, query_id: str = "query_id", vector: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(``query_id, id, distance, similarity, rank`` as ``neighbours.knn`` gives them; ``query_id, compared`` pairs).

    ``rows`` as ``deal`` makes them. Queries with a null id or vector are left out; ids of queries must identify them.
    """
    asked = queries.filter(F.col(vector).isNotNull() & F.col(query_id).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"), F.lit(float("inf")).alias("bound")
    )
    fields = [T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", rows.schema["id"].dataType)]
    schema = T.StructType([*fields, T.StructField("distance", T.DoubleType()), T.StructField("compared", T.LongType())])
    asked, hits = materialise(asked, "pivot-queries"), rows.sparkSession.createDataFrame([], schema)
    visited, many = 0, len(pivots.centres)
    # as many blocks as keep the tasks busy, but none beyond its bounds
    sides = math.ceil(math.sqrt(4 * rows.sparkSession.sparkContext.defaultParallelism))
    fair = max(LEAST_BLOCK, math.ceil(int(pivots.n.sum()) / sides))
    block = max(1, min(BLOCK_ROWS, fair, BLOCK_BYTES // max(1, 8 * pivots.centres.shape[1])))
    bundles = _bundles(pivots, block)
    # the first round goes on until any query has met k rows, where pivots are small
    smallest = np.sort(pivots.n[pivots.n > 0])
    upto = max(1, int(np.searchsorted(np.cumsum(smallest), k)) + 1)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    while visited < many:
        now = materialise(_ask(asked, pivots, bundles, visited, upto), "pivot-asked")
        met = materialise(_meet(now, rows, pivots, bundles, block, k, schema), "pivot-met")
        told = hits.unionByName(met).filter("id IS NULL").groupBy("query_id").agg(F.sum("compared").alias("compared"))
        told = told.select("query_id", *(F.lit(None).cast(schema[c].dataType).alias(c) for c in ("id", "distance")), "compared")
        best = hits.unionByName(met).filter("id IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        hits = materialise(best.drop("rank").unionByName(told), "pivot-hits")
        kth = hits.filter("id IS NOT NULL").groupBy("query_id").agg(F.count("id").alias("n"), F.max("distance").alias("worst"))
        kth = kth.filter(F.col("n") == k).select("query_id", F.sqrt("worst").alias("kth"))
        asked = asked.join(kth, "query_id", "left").select("query_id", "v", F.coalesce("kth", "bound").alias("bound"))
        asked, visited, upto = materialise(asked, "pivot-queries"), upto, upto * FAN
    found = hits.filter("id IS NOT NULL").withColumn("rank", F.row_number().over(order))
    compared = hits.filter("id IS NULL").groupBy("query_id").agg(F.sum("compared").alias("compared"))
    return found.select("query_id", "id", "distance", similarity(F.col("distance")).alias("similarity"), "rank"), compared


def pivot_knn(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """The same rows as ``neighbours.knn``, for corpora and query tables of any size."""
    centres = choose_pivots(corpus, id_col, vector)
    dealt = materialise(deal(corpus, centres, id_col, vector, metadata=False), "pivot-rows")
    return search(dealt, pivots_of(centres, pivot_sizes(dealt)), queries, k, query_id, vector)[0]

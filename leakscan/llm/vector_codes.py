"""Vector codes: product quantisation whose nearest entries are found by equal-average search.

A vector is cut into equal consecutive parts, and each part is written as the number of the nearest entry of its codebook.
All arithmetic is on integers. Codebooks start as the parts of the vectors of the smallest ids and are improved by a fixed
number of rounds, each of which replaces an entry by the mean (rounded down) of the parts assigned to it.

Equal-average search: entries lie in the order of their component sums. From the place of a part's own sum the search goes
outwards, always to the side whose sum is nearer, and ends once the squared gap of sums divided by the width strictly exceeds
the best squared distance so far: by Cauchy and Schwarz no entry further out can be as near, not even a tied one.

Plan: one map-only pass drops unusable rows and writes the integers to the shared folder. Each round is one pass over them: a
task searches its vectors and adds up counts and component sums per entry, Spark adds up those of the tasks, and only the sums of
the codebooks (parts x entries x width) reach the driver. The last pass is map-only. Totals per label are aggregated and joined
back as a lookup whose size is checked, so no label is gathered in one task.

Cases: a vector that is null or empty, or holds a null or a component that is not finite: dropped. So is one whose width is not a
multiple of the number of parts or not that of the smallest id, and one with a component so large that a long could not
hold its error (for 64 components from 2**17 on). Null id: sorts last. Repeated ids or rows: each is a row of its own. Ties:
the lower index. Fewer rows than entries: so many entries. Null labels are one label. Empty table: no rows. Clashing columns: only id,
vector and label are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.common import table
from leakscan.operators.lookup import bounded_lookup
from leakscan.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


def largest(width: int) -> int:
    """Bound on a component's magnitude below which the error of a whole vector fits into a long."""
    bits = 0
    while width * 4 ** (bits + 2) < 2**63:
        bits += 1
    return 2**bits


class EqualAverage:
    """Exact nearest entries of one codebook (entries x width, integers)."""

    def __init__(self, book: np.ndarray):
        sums = book.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = np.concatenate([[-np.inf], sums[self.order].astype(float), [np.inf]])  # entry i stands at i + 1
        self.book, self.width = book[self.order], book.shape[1]
        self.most = int(np.abs(book).max(initial=0))
        self.searched = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row; equally near entries: the lower index."""
        most = max(self.most, int(np.abs(points).max(initial=0)))
        exact = np.float64 if self.width * 4 * most * most < 2**53 else np.int64
        book, near = self.book.astype(exact), points.astype(exact)
        own = points.sum(axis=1).astype(float)
        right = np.searchsorted(self.sums, own)
        left = right - 1
        best = np.full(len(points), np.iinfo(np.int64).max, dtype=np.int64)
        code = np.full(len(points), len(book), dtype=np.int64)
        out_code, out_best, row = code.copy(), best.copy(), np.arange(len(points))
        while len(row):
            below, above = own - self.sums[left], self.sums[right] - own
            up = above < below
            gap = np.where(up, above, below)
            # A shade above one, so that rounding can only prolong the search.
            over = gap * gap > best * (self.width * (1 + 1e-12))
            live = ~over
            if not live.all():
                done = row[over]
                out_code[done], out_best[done] = code[over], best[over]
                row, near, own, left, right, best, code, up = (x[live] for x in (row, near, own, left, right, best, code, up))
                if not len(row):
                    break
            at = np.where(up, right, left) - 1
            far = book[at] - near
            distance = np.einsum("ij,ij->i", far, far).astype(np.int64)
            self.searched += len(row)
            number = self.order[at]
            better = (distance < best) | ((distance == best) & (number < code))
            best, code = np.where(better, distance, best), np.where(better, number, code)
            right, left = right + up, left - ~up
        return out_code, out_best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def integers(vectors: DataFrame, key: str, vector: str, label: str | None, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(key, label, ints) of the usable rows, written to the shared folder."""
    rows = vectors.select(
        F.col(f"`{key}`").alias("key"),
        (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )

    def whole(batches):
        for b in batches:
            # a null list may stand over components of its own, which flatten() leaves out
            lists = b.column("vector")
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)  # null: nan
            of = np.repeat(np.arange(len(lists)), sizes)
            bound = np.array([largest(int(n)) if n else 0 for n in sizes], dtype=float)
            good = np.abs(flat) < bound[of]
            bad = np.bincount(of[~good], minlength=len(lists)) > 0
            keep = ~bad & (sizes > 0) & (sizes % parts == 0)
            inside = keep[of]
            starts = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key").take(at),
                    b.column("label").take(at),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(flat[inside].astype(np.int64))),
                ],
                names=["key", "label", "ints"],
            )

    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "label")]
    made = materialise(rows.mapInArrow(whole, f"key {kinds[0]}, label {kinds[1]}, ints array<long>"), "vector-integers")
    first = made.select("key", F.size("ints").alias("width")).orderBy(F.col("key").asc_nulls_last(), "width").first()
    return made.filter(F.size("ints") == (first["width"] if first else 0))


def start(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (parts x entries x width) out of the vectors of the smallest ids."""
    least = rows.orderBy(F.col("key").asc_nulls_last(), "ints").limit(entries).select("ints").collect()  # bounded by ``entries``
    whole = np.array([r["ints"] for r in least], dtype=np.int64)
    return whole.reshape(len(least), parts, -1).transpose(1, 0, 2) if len(least) else np.zeros((parts, 0, 0), np.int64)


def improve(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the mean, rounded down, of the parts nearest to it; unused entries stay."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        search = [EqualAverage(b) for b in shared.value]
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            whole = _matrix(b.column("ints"), parts * width)
            for p in range(parts):
                mine = whole[:, p * width : (p + 1) * width]
                code, _ = search[p].nearest(mine)
                n[p] += np.bincount(code, minlength=entries)
                np.add.at(sums[p], code, mine)
        part, entry = np.nonzero(n)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(sums[part, entry].reshape(-1))
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), lists],
            names=["part", "entry", "n", "sums"],
        )

    added = (
        rows.select("ints")
        .mapInArrow(add, "part int, entry int, n long, sums array<long>")
        .groupBy("part", "entry")
        .agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    )
    out = books.copy()
    for r in added.collect():  # one row per entry of a codebook
        out[r["part"], r["entry"]] = np.array(r["sums"], dtype=np.int64) // r["n"]
    shared.unpersist()
    return out


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """key, label, code (two hex digits a part) and error of each row."""
    parts, _, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def tell(batches):
        search = [EqualAverage(b) for b in shared.value]
        for b in batches:
            whole = _matrix(b.column("ints"), parts * width)
            codes, error = np.empty((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
            for p in range(parts):
                code, distance = search[p].nearest(whole[:, p * width : (p + 1) * width])
                codes[:, p] = code
                error += distance
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                names=["key", "label", "code", "error"],
            )

    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "label")]
    return rows.mapInArrow(tell, f"key {kinds[0]}, label {kinds[1]}, code string, error long")


def reconstruct(code: str, books: np.ndarray) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))])


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, key: str, vector: str, label: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error of every usable vector; the codebooks)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, so a codebook has at most 256 entries")
    rows = integers(vectors, key, vector, label, parts)
    books = start(rows, parts, entries)
    if books.shape[1]:
        for _ in range(rounds):
            books = improve(rows, books)
    return assign(rows, books), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the sum of the errors of all rows of the same label."""
    coded = materialise(coded, "vector-codes")
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(bounded_lookup(total), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return with_label_error(coded).select(
        F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def _sql() -> str:
    """The same by brute force: all distances in each round, for small tables."""
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """parts AS (SELECT k.vec_id, k.label, p.part, k.v[p.part * (len(k.v) // 4) + 1 : (p.part + 1) * (len(k.v) // 4)] AS x
  FROM kept k, (SELECT unnest(range(4)) AS part) p)""",
        """book0 AS (SELECT part, x AS e, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS i
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))""",
    ]
    for r in range(5):
        steps.append(
            f"""near{r} AS MATERIALIZED (SELECT vec_id, part, min(d) AS d, arg_min(i, d * 256 + i) AS i FROM (
  SELECT p.vec_id, p.part, b.i, list_sum(list_transform(list_zip(p.x, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts p JOIN book{r} b ON p.part = b.part) GROUP BY vec_id, part)"""
        )
        if r < 4:
            steps.append(
                f"""mean{r} AS (SELECT part, i, list(floor(s / n)::BIGINT ORDER BY k) AS e FROM (
  SELECT n.part, n.i, u.k, sum(p.x[u.k])::DOUBLE AS s, count(*) AS n FROM near{r} n JOIN parts p ON n.vec_id = p.vec_id AND n.part = p.part,
  LATERAL (SELECT unnest(range(1, len(p.x) + 1)) AS k) u GROUP BY n.part, n.i, u.k) GROUP BY part, i)"""
            )
            steps.append(
                f"""book{r + 1} AS MATERIALIZED (SELECT b.part, coalesce(m.e, b.e) AS e, b.i FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.i = m.i)"""
            )
    steps.append(
        """coded AS (SELECT vec_id, string_agg(printf('%02x', i::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near4 GROUP BY vec_id)"""
    )
    steps.append(
        """digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, i)) AS h FROM book4)"""
    )
    return (
        "WITH "
        + ",\n".join(steps)
        + """
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, d.h AS codebooks_sha256
FROM coded c JOIN kept k ON c.vec_id = k.vec_id, digest d"""
    )


SQL = _sql()

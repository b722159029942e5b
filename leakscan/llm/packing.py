"""Best-fit packing after Martello-Toth dominance reduction.

Only longer documents are cut, into pieces of the capacity. What there is to pack is then a histogram of piece lengths, which
has at most as many entries as the capacity however many documents there are. On it the reduction fixes sets that dominate
all alternatives for the largest piece: the piece alone if nothing fits beside it; with the largest piece that fills the
sequence exactly; with the largest that fits if no two others fit; and with the largest that fits if no two others that fit
fill more and no three fit. What remains is packed best-fit, largest first, whole runs of equal pieces at a time. The result
is a list of slots (length, range of ranks, sequence, offset) of bounded size; each piece takes the slot of its rank.

Plan: one map-only pass makes ids and writes one narrow row per piece; the histogram is one aggregation; ranks within a
length are counted inside salted parts of bounded size, whose starts come from a small table, so no length is ranked in one
task. Texts are never shuffled.

Cases: null or empty text: the end id alone. Repeated rows: each is packed. Empty table: no rows. Any id type.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscan.llm.common import give_back, spans, table, text_bytes
from leakscan.llm.word_bpe import TABLE_BYTES, WordBpe
from leakscan.session import materialise

CAPACITY = 4096
#: Pieces of one length that are ranked in one task.
RANKED = 100_000
#: Bytes of text encoded at a time.
BLOCK = 8_000_000


class _Lengths:
    """Counts of lengths that are left, with the nearest ones below and above."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.order.remove(length)

    def largest_to(self, bound: int, without: int) -> int | None:
        """The largest length up to the bound, other than one piece of length ``without``."""
        for k in reversed(self.order):
            if k <= bound and self.counts[k] > (k == without):
                return k
        return None

    def smallest(self, n: int, without: int) -> list[int]:
        out: list[int] = []
        for k in self.order:
            out += [k] * min(n - len(out), self.counts[k] - (k == without))
            if len(out) == n:
                break
        return out

    def best_pair(self, bound: int, without: int) -> int:
        """The largest sum, up to the bound, of two pieces."""
        best, high = 0, len(self.order) - 1
        for low, a in enumerate(self.order):
            while high >= low and a + self.order[high] > bound:
                high -= 1
            if high < low:
                break
            b = self.order[high]
            if self.counts[a] - (a == without) > (a == b) and self.counts[b] > (b == without):
                best = max(best, a + b)
        return best


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed sets with how often each, counts of what is left)."""
    left, fixed = _Lengths(counts), []
    changed = True
    while changed:
        changed = False
        for x in sorted(left.counts, reverse=True):
            while left.counts.get(x):
                partner = _dominating(left, x, capacity - x)
                if partner is None:
                    break
                if partner:
                    n = left.counts[x] // 2 if partner == x else min(left.counts[x], left.counts[partner])
                    left.take(x, n)
                    left.take(partner, n)
                else:
                    n = left.counts[x]
                    left.take(x, n)
                fixed.append(((x, partner) if partner else (x,), n))
                changed = True
    return fixed, left.counts


def _dominating(left: _Lengths, x: int, rest: int) -> int | None:
    """The length whose set with x dominates all sets with x; 0 for x alone; None if none is known to."""
    best = left.largest_to(rest, x)
    if best is None:
        return 0
    few = left.smallest(3, x)
    if best == rest or len(few) < 2 or few[0] + few[1] > rest:
        return best
    if (len(few) < 3 or sum(few) > rest) and best >= left.best_pair(rest, x):
        return best
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths in a sequence, number of such sequences)."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by free room
    for x in sorted(counts, reverse=True):
        n = counts[x]
        for room in sorted(r for r in open_bins if r >= x):
            while n and open_bins.get(room):
                content, bins = open_bins[room].pop()
                each = room // x
                full, last = min(bins, n // each), 0
                if full < bins and n - full * each:
                    last = n - full * each
                if full:
                    open_bins.setdefault(room - each * x, []).append((content + (x,) * each, full))
                if last:
                    open_bins.setdefault(room - last * x, []).append((content + (x,) * last, 1))
                if bins - full - bool(last):
                    open_bins[room].append((content, bins - full - bool(last)))
                n -= full * each + last
            if not n:
                break
        each = capacity // x
        if n // each:
            open_bins.setdefault(capacity - each * x, []).append(((x,) * each, n // each))
        if n % each:
            open_bins.setdefault(capacity - n % each * x, []).append(((x,) * (n % each), 1))
    return [group for groups in open_bins.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, dict[str, np.ndarray]]:
    """Slots by length: ranks from ``start`` on go, ``each`` to a sequence, to ``sequence`` and its successors at ``offset``."""
    fixed, left = reduce(counts, capacity)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for content, bins in fixed + best_fit(left, capacity):
        offset = 0
        for length, each in Counter(content).items():
            slots.setdefault(length, []).append((used[length], each, sequence, offset))
            used[length] += each * bins
            offset += each * length
        sequence += bins
    names = ("start", "each", "sequence", "offset")
    return {k: {n: np.array(c, dtype=np.int64) for n, c in zip(names, zip(*v, strict=True), strict=True)} for k, v in slots.items()}


def pieces(
    docs: DataFrame,
    keep: list[str],
    tokenizer: str,
    end: int,
    capacity: int = CAPACITY,
    text: str = "text",
    ids: bool = False,
    block: int = BLOCK,
    table_bytes: int = TABLE_BYTES,
    trim: bool = False,
) -> DataFrame:
    """The columns ``keep`` (struct ``kept``), piece, start, length, ids_crc32 for every piece, and with ``ids`` the ids (binary).

    ``block`` and ``table_bytes`` bound what a worker holds beside the tokenizer, whatever it reads; with ``trim`` it gives back what it
    freed after each batch. Smaller ones and ``trim`` take more time.
    """
    kept = F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)))
    rows = docs.select(kept.alias("kept"), text_bytes(text).alias("text"))
    width, last = 4 * capacity, end.to_bytes(4, "little")
    shared = docs.sparkSession.sparkContext.broadcast({"path": tokenizer})

    def cut(batches):
        worker = shared.value  # lives as long as the worker, and with it the table of words
        if "bpe" not in worker:
            give_back()  # what the tasks of earlier stages left
            worker["bpe"] = WordBpe(worker["path"], table_bytes)
        for b in batches:
            column = b.column("text")
            for i, j in spans(pc.binary_length(column).to_numpy(), block):
                of, number, made = [], [], []
                texts = [t.decode("utf-8", "replace") for t in column.slice(i, j - i).to_pylist()]
                for r, whole in enumerate(worker["bpe"].encode(texts)):
                    whole += last
                    for k in range(0, len(whole), width):
                        of.append(i + r)
                        number.append(k // width)
                        made.append(whole[k : k + width])
                columns = {
                    "kept": b.column("kept").take(pa.array(of, pa.int64())),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array([n * capacity for n in number], pa.int64()),
                    "length": pa.array([len(x) // 4 for x in made], pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.array(made, pa.binary())
                columns["ids_crc32"] = pa.array(map(zlib.crc32, made), pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            if trim:
                give_back()  # of a batch of texts little is kept

    kind = rows.schema["kept"].dataType.simpleString()
    told = ", ids binary" * ids + ", ids_crc32 long"
    return rows.mapInArrow(cut, f"kept {kind}, piece int, start long, length long" + told)


def place(rows: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """Adds sequence_id and offset to rows with ``kept``, ``piece`` and ``length``; the rows are read twice."""
    spark = rows.sparkSession
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity``
    shared = spark.sparkContext.broadcast(plan(counts, capacity))
    if counts:
        parts = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, -(-n // ranked))))
    else:
        parts = F.create_map(F.lit(0).cast("long"), F.lit(1))
    salt = F.pmod(F.xxhash64("kept", "piece"), F.coalesce(parts[F.col("length")], F.lit(1))).alias("salt")
    salted = rows.select("*", salt)
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("kept", "piece")
    numbered = salted.join(starts, ["length", "salt"]).withColumn(
        "rank", F.col("first") + F.row_number().over(inside) - 1
    )
    names = [c for c in rows.columns]

    def assign(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                s = shared.value[int(k)]
                slot = np.searchsorted(s["start"], rank[at], side="right") - 1
                nth = rank[at] - s["start"][slot]
                sequence[at] = s["sequence"][slot] + nth // s["each"][slot]
                offset[at] = s["offset"][slot] + nth % s["each"][slot] * k
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return numbered.select(*names, "rank").mapInArrow(assign, f"{kinds}, sequence_id long, offset long")


def pack(
    docs: DataFrame,
    keep: list[str],
    tokenizer: str,
    end: int = 1,
    capacity: int = CAPACITY,
    text: str = "text",
    ids: bool = False,
    block: int = BLOCK,
    table_bytes: int = TABLE_BYTES,
    trim: bool = False,
) -> DataFrame:
    """Per piece: the columns ``keep``, piece, start, length, ids_crc32, sequence_id, offset, and with ``ids`` the ids."""
    made = pieces(docs, keep, tokenizer, end, capacity, text, ids, block, table_bytes, trim)
    placed = place(materialise(made, "pieces"), capacity)
    return placed.select(
        *(F.col(f"kept.k{i}").alias(k) for i, k in enumerate(keep)),
        *(c for c in placed.columns if c != "kept"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))

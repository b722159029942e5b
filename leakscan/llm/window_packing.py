"""Best-fit-decreasing packing of documents into windows with little padding.

Documents longer than a window are first cut into full windows; what remains of them, and every shorter document, is a piece.
Pieces are placed largest first, each into the open window with the least room that holds it, which a segment tree indexed by
remaining room finds. Pieces of one length are placed by runs, which gives the same windows as one by one: after a piece
the tightest window that takes the next of its length is the same one, as long as it has the room. Only the histogram of
lengths is needed, and the outcome is a list of slots of bounded size.

A window at a power of two needs no padding. Windows that best fit leaves with more than ``slack`` tokens to pad are dissolved:
their pieces are laid end to end and cut at every window's end, the last stretch at powers of two. So padding is at most
slack tokens a window whatever the lengths are, and only pieces of dissolved windows are cut, nearly always once.

Plan: a task makes ids and writes one row per piece with its number among the task's pieces of that length; the ids of full
windows are left out. Numbers of tasks are added up per (task, length), so ranks need neither a sort nor a group. Slots are
looked up map-only. Rows of lengths that dissolved windows hold carry their ids through the exchange, all others none.

Cases: null or empty text: the end id alone. Repeated rows: each is packed by itself. Very long texts are cut into windows as
they are encoded. Empty table: no rows. Any id type and further columns: only the text and the columns asked for are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscan.llm.byte_chunks import ByteChunks, faithful
from leakscan.llm.common import blocks, table, text_bytes
from leakscan.session import materialise

CAPACITY = 2048
#: Tokens that a window may have to pad before it is dissolved, as a share of the capacity.
SLACK = 1 / 256
#: Bytes of text whose pieces are handed on at a time.
BLOCK = 8_000_000


class Rooms:
    """Open windows by remaining room: a segment tree over the rooms, whose nodes hold how many windows lie below."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def add(self, room: int, content: tuple[tuple[int, int], ...], bins: int) -> None:
        self.windows.setdefault(room, []).append((content, bins))
        self._change(room, bins)

    def take(self, room: int) -> tuple[tuple[tuple[int, int], ...], int]:
        content, bins = self.windows[room].pop()
        self._change(room, -bins)
        return content, bins

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest room of an open window that is at least ``least``."""
        node = self.leaves + least
        if self.count[node]:
            return least
        while node > 1:  # up until a right sibling has windows, then down to its leftmost
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """((length, times), ... of a window; number of such windows)."""
    rooms = Rooms(capacity)
    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            room = rooms.tightest(x)
            if room is None:
                each = capacity // x
                if left >= each:
                    rooms.add(capacity - each * x, ((x, each),), left // each)
                if left % each:
                    rooms.add(capacity - left % each * x, ((x, left % each),), 1)
                break
            content, bins = rooms.take(room)
            each = room // x
            full = min(bins, left // each)
            rest = min(left - full * each, each) if full < bins else 0
            if full:
                rooms.add(room - each * x, (*content, (x, each)), full)
            if rest:
                rooms.add(room - rest * x, (*content, (x, rest)), 1)
            if bins - full - bool(rest):
                rooms.add(room, content, bins - full - bool(rest))
            left -= full * each + rest
    return [w for same in rooms.windows.values() for w in same]


class Plan:
    """Where the piece of some rank among those of its length goes."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, slack: float = SLACK):
        self.capacity = capacity
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        used = dict.fromkeys(counts, 0)
        self.windows = 0
        for content, bins in best_fit_decreasing(counts, capacity):
            total = sum(x * n for x, n in content)
            if capacity - total > slack * capacity and total & (total - 1):
                continue
            offset = 0
            for x, n in content:
                slots.setdefault(x, []).append((used[x], n, self.windows, offset))
                used[x] += n * bins
                offset += n * x
            self.windows += bins
        self.slots = {x: np.array(s, dtype=np.int64).T for x, s in slots.items()}
        # what is left over, end to end: of each length the first rank and its place
        self.loose, end = {}, 0
        for x in sorted(counts, reverse=True):
            if counts[x] > used[x]:
                self.loose[x] = (used[x], end)
                end += x * (counts[x] - used[x])
        tail = end % capacity
        powers = [1 << k for k in reversed(range(capacity.bit_length())) if tail >> k & 1]
        self.full = end // capacity
        #: Beginnings of the last stretch's cuts.
        self.tail = self.full * capacity + np.concatenate([[0], np.cumsum(powers, dtype=np.int64)[:-1]]).astype(np.int64)
        self.sequences = self.windows + self.full + len(powers)

    def _stretch(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < self.full * self.capacity, at // self.capacity, self.full + np.searchsorted(self.tail, at, side="right") - 1)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, tokens before, length, sequence, offset) of every piece after the cuts."""
        row, before, size = np.arange(len(length)), np.zeros_like(length), length.copy()
        sequence, offset = np.empty_like(length), np.empty_like(length)
        loose = np.zeros(len(length), dtype=bool)
        for x in np.unique(length).tolist():
            at = np.flatnonzero(length == x)
            first, base = self.loose.get(x, (np.iinfo(np.int64).max, 0))
            late = rank[at] >= first
            loose[at[late]] = True
            offset[at[late]] = base + (rank[at[late]] - first) * x  # the place along all loose pieces, for now
            at = at[~late]
            if len(at):
                start, each, window, inside = self.slots[x]
                slot = np.searchsorted(start, rank[at], side="right") - 1
                nth = rank[at] - start[slot]
                sequence[at] = window[slot] + nth // each[slot]
                offset[at] = inside[slot] + nth % each[slot] * x
        if not loose.any():
            return row, before, size, sequence, offset
        begin, end = offset[loose], offset[loose] + length[loose]
        low, high = self._stretch(begin), self._stretch(end - 1)
        parts = high - low + 1
        whole = np.repeat(np.arange(len(begin)), parts)
        stretch = low[whole] + np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts)
        edge = np.where(stretch < self.full, stretch * self.capacity, self.tail[np.clip(stretch - self.full, 0, len(self.tail) - 1)])
        after = np.where(stretch + 1 < self.full, (stretch + 1) * self.capacity, self.tail[np.clip(stretch + 1 - self.full, 0, len(self.tail) - 1)])
        after = np.where(stretch == high[whole], end[whole], after)
        head = np.maximum(edge, begin[whole])
        return tuple(
            np.concatenate([a[~loose], b])
            for a, b in (
                (row, np.flatnonzero(loose)[whole]),
                (before, head - begin[whole]),
                (size, np.minimum(after, end[whole]) - head),
                (sequence, self.windows + stretch),
                (offset, head - edge),
            )
        )


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of each piece among those of its length; ``seen`` counts on."""
    by = np.argsort(lengths, kind="stable")
    ordered = lengths[by]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    count = np.diff(np.append(begin, len(ordered)))
    out = np.empty_like(lengths)
    out[by] = np.arange(len(ordered)) - np.repeat(begin, count) + seen[ordered]
    seen[ordered[begin]] += count
    return out


def pieces(docs: DataFrame, keep: list[str], tokenizer: str, end: int, capacity: int, text: str, ids: bool) -> DataFrame:
    """``kept``, start, length, doc_tokens, ids_crc32, ids (of full windows null, unless asked for), task, nth."""
    kept = F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)))
    rows = docs.select(kept.alias("kept"), text_bytes(text).alias("text"))
    width, last = 4 * capacity, end.to_bytes(4, "little")
    shared = docs.sparkSession.sparkContext.broadcast({"path": tokenizer, "fast": faithful(tokenizer)})

    def cut(batches):
        worker = shared.value  # lives as long as the worker, and with it the table of chunks
        if "bpe" not in worker:
            worker["bpe"] = ByteChunks(worker["path"], worker["fast"])
        seen, task = np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        encode = worker["bpe"].encode
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in blocks(texts, BLOCK):
                of, start, total, parts = [], [], [], []
                for r in range(i, j):
                    whole = encode(texts[r].decode("utf-8", "replace")) + last
                    for k in range(0, len(whole), width):
                        of.append(r)
                        start.append(k // 4)
                        total.append(len(whole) // 4)
                        parts.append(whole[k : k + width])
                length = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("kept").take(pa.array(of, pa.int64())),
                        pa.array(start, pa.int64()),
                        pa.array(length),
                        pa.array(total, pa.int64()),
                        pa.array(map(zlib.crc32, parts), pa.int64()),
                        pa.array([p if ids or len(p) < width else None for p in parts], pa.binary()),
                        pa.array(np.full(len(parts), task)),
                        pa.array(_numbered(length, seen)),
                    ],
                    names=["kept", "start", "length", "doc_tokens", "ids_crc32", "ids", "task", "nth"],
                )

    kind = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(
        cut, f"kept {kind}, start long, length long, doc_tokens long, ids_crc32 long, ids binary, task long, nth long"
    )


def pack(
    docs: DataFrame, keep: list[str], tokenizer: str, end: int = 1, capacity: int = CAPACITY, slack: float = SLACK, text: str = "text", ids: bool = False
) -> DataFrame:
    """Per piece: the columns ``keep``, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``ids`` the ids."""
    made = materialise(pieces(docs, keep, tokenizer, end, capacity, text, ids), "window-pieces")
    sizes = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes, "window-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity``
    plan = Plan(counts, capacity, slack)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    starts = sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    narrow = made if ids else made.withColumn("ids", F.lit(None).cast("binary"))
    if plan.loose:
        cut = F.col("length").isin(list(plan.loose))
        narrow = made.filter(cut).unionByName(narrow.filter(~cut))
    # The starts grow with the tasks, so they are never broadcast.
    ranked = narrow.join(starts.hint("merge"), ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(plan))  # arrays only: a class would have to be installed there

    def assign(batches):
        known = Plan.__new__(Plan)
        known.__dict__.update(shared.value)
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row, head, size, sequence, offset = known.place(length.astype(np.int64), rank.astype(np.int64))
            at = pa.array(row)
            start, crc, raw = (b.column(c).take(at) for c in ("start", "ids_crc32", "ids"))
            crc = crc.to_numpy(zero_copy_only=False).copy()
            raw = raw.to_pylist()
            for i in np.flatnonzero(size < length[row]).tolist():
                raw[i] = raw[i][4 * head[i] : 4 * (head[i] + size[i])]
                crc[i] = zlib.crc32(raw[i])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("kept").take(at),
                    pa.array(start.to_numpy(zero_copy_only=False) + head),
                    pa.array(size),
                    pa.array(crc),
                    b.column("doc_tokens").take(at),
                    pa.array(sequence),
                    pa.array(offset),
                    pa.array(raw if ids else [None] * len(raw), pa.binary()),
                ],
                names=["kept", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    kind = made.schema["kept"].dataType.simpleString()
    placed = ranked.select("kept", "start", "length", "doc_tokens", "ids_crc32", "ids", "rank").mapInArrow(
        assign, f"kept {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return placed.select(
        *(F.col(f"kept.k{i}").alias(k) for i, k in enumerate(keep)),
        *(c for c in placed.columns if c != "kept" and (ids or c != "ids")),
    )


def op13_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))

"""Near-duplicates by Order MinHash: candidates from minimum k-mers in text order, verified by banded alignment.

The k-mers are shingles of five words, each labelled with how often it occurred before in the text. For each of a number of
hash orders the text's smallest labelled shingles are taken and put back into text order; two texts agree in such a sample
only if they share these shingles in the same order. A sample is taken at several depths (4, 8, 16 shingles). Texts that agree
at the first depth share a bucket; buckets are read in the order of the deeper samples, so in a large bucket the most
alike texts are neighbours. Within overlapping windows of a bucket a maximum spanning forest over the agreement of the
samples proposes pairs: at most one fewer than there are texts. Proposed pairs are aligned on their shingles within the band
that the wanted similarity allows, and linked if (common in order) / (either) reaches it. Links are closed to classes by
alternating large and small stars.

Windows and failed pairs leave links out, so texts meet again: in every bucket that still holds several classes all texts of
different classes are held against each other by their agreement, and those that agree enough by their shingles at once, where
they meet: a pair in the first bucket that it shares, unless links found there have made one class of its two. Only links leave
the task, fewer than the texts that meet there. After that no two texts of different classes that share a bucket and agree
enough are untried, so classes depend neither on windows nor on partitions; what sampling itself may miss (a pair at the
similarity shares no bucket once in some 300 000 times, agrees too little once in some 5 000) is all that can be lost.

Plan: copies of a text are one row from the first aggregation on (partial, so a much copied text is no hot key). Samples go through
one range partitioning by the bucket and the deeper samples, which splits a large bucket over tasks. Where texts meet again a large
bucket is cut into blocks by a hash of the id, and a task holds two blocks against each other; what that takes grows
with the square of the texts of a bucket that are not yet of one class. Texts are read again for proposed texts only, one row per
text. Nothing goes through the driver but counts.

Cases: texts without words (null, empty, white space) are each a class of their own. Fewer than five words: all of them are one
shingle. Case of A-Z and white space do not count. Repeated rows are copies. Null ids belong to classes like others; the
class id is the smallest id that is not null. Columns beside id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.align import banded_common
from leakscan.llm.common import fresh, released, table, text_bytes
from leakscan.session import materialise

SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, DEPTHS = 24, (4, 8, 16)
#: Share of samples whose smallest shingle must agree for a pair to be proposed; at similarity 0.8 four in five are expected.
AGREEMENT = 0.5
#: Texts of a bucket that are compared with each other; windows overlap by half.
WINDOW = 128
#: Texts of a block where the texts of a bucket meet again, and bytes of their shingles; shingles that are looked up at a time.
BLOCK, BLOCK_BYTES, LOOKED_UP = 4096, 32_000_000, 1 << 21
#: Shingles that are hashed at a time.
STEP = 1 << 15
_DRAW = np.random.default_rng(20240229)
_FOLD = _DRAW.integers(1, 1 << 63, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_XOR = _DRAW.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_TIMES = _DRAW.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_HALF, _MIX = np.uint64(32), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> _HALF)


class Shingler:
    """Hashes of the shingles of texts, in text order."""

    def __init__(self, entries: int = 400_000):
        self._words: dict[bytes, int] = {}
        self._entries = entries

    def __call__(self, raw: bytes) -> np.ndarray:
        import xxhash

        words = raw.lower().split()
        known = self._words
        if len(known) > self._entries:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        if not len(words):
            return hashes
        if len(words) < SHINGLE:
            return _mix((hashes * _FOLD[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
        n = len(words) - SHINGLE + 1
        return _mix(sum(hashes[k : k + n] * _FOLD[k] for k in range(SHINGLE)))


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingles mixed with the number of equal ones before them."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    if new.all():
        return shingles
    at = np.arange(len(ordered))
    before = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(shingles)
    out[order] = _mix(ordered + before.astype(np.uint64) * _MIX)
    return out


def distinct(shingles: np.ndarray) -> np.ndarray:
    """First occurrences in text order."""
    _, first = np.unique(shingles, return_index=True)
    return shingles[np.sort(first)]


def sample(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, depths x samples; one byte of the smallest shingle per sample)."""
    items, deepest = labelled(shingles), DEPTHS[-1]
    best = np.empty((0, SAMPLES), dtype=np.int64)  # positions of the smallest, any order
    for start in range(0, len(items), STEP):
        part = np.arange(start, min(start + STEP, len(items)))
        places = np.concatenate([best, np.broadcast_to(part[:, None], (len(part), SAMPLES))])
        values = (items[places] ^ _XOR) * _TIMES
        if len(places) > deepest:
            best = np.take_along_axis(places, np.argpartition(values, deepest - 1, axis=0)[:deepest], axis=0)
        else:
            best = places
    values = (items[best] ^ _XOR) * _TIMES
    best = np.take_along_axis(best, np.argsort(values, axis=0), axis=0)
    keys = np.empty((len(DEPTHS), SAMPLES), dtype=np.uint64)
    for row, depth in enumerate(DEPTHS):
        in_text = items[np.sort(best[:depth], axis=0)]
        keys[row] = _mix((in_text * _FOLD[: len(in_text), None]).sum(axis=0) ^ _XOR)
    return keys, (items[best[0]] >> np.uint64(13)).astype(np.uint8)


def forest(signatures: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Edges of a maximum spanning forest over the number of equal bytes, those below ``least`` left out."""
    n = len(signatures)
    if n == 2:
        if (signatures[0] == signatures[1]).sum() >= least:
            yield 0, 1
        return
    best = np.full(n, -1)
    parent = np.zeros(n, dtype=np.int64)
    inside = np.zeros(n, dtype=bool)
    at = 0
    for _ in range(n):
        inside[at] = True
        if best[at] >= least:
            yield int(parent[at]), at
        agree = (signatures == signatures[at]).sum(axis=1)
        closer = ~inside & (agree > best)
        best[closer], parent[closer] = agree[closer], at
        at = int(np.where(inside, -2, best).argmax())


def verified(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sequences have the wanted share of shingles in common, and have them in common order.

    The share is that of distinct shingles (common / either). The order is that of their first occurrences, or, as an edit
    in a repeated passage moves these, that of all shingles.
    """
    first, second = distinct(one), distinct(two)
    if not _enough(len(np.intersect1d(first, second, assume_unique=True)), len(first) + len(second), similarity):
        return False
    return _aligned(first, second, similarity) or (len(first) < len(one) and _aligned(one, two, similarity))


def _alike(batches, similarity: float):
    """The pairs whose sets of shingles (sorted, without repeats) reach the similarity."""
    for b in batches:
        good = []
        for one, two in zip(b.column("one").to_pylist(), b.column("two").to_pylist(), strict=True):
            first, second = np.frombuffer(one, np.uint32), np.frombuffer(two, np.uint32)
            total = len(first) + len(second)
            if not _enough(min(len(first), len(second)), total, similarity):
                good.append(False)
                continue
            both = np.sort(np.concatenate([first, second]), kind="stable")  # merges two sorted runs
            good.append(_enough(int(np.count_nonzero(both[1:] == both[:-1])), total, similarity))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _enough(common: int, total: int, similarity: float) -> bool:
    return common >= similarity / (1 + similarity) * total - 1e-9


def _aligned(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Aligns what is left between the common ends, within the band beyond which too little could be common."""
    total = len(one) + len(two)
    same = 0
    for _ in range(2):  # both ends
        short = min(len(one), len(two))
        differs = np.flatnonzero(one[:short] != two[:short])
        end = int(differs[0]) if len(differs) else short
        one, two, same = one[end:][::-1], two[end:][::-1], same + end
    band = int(total * (1 - similarity) / (1 + similarity)) + 1
    return _enough(same + banded_common(one.tolist(), two.tolist(), band), total, similarity)


def _identity(text: str):
    """Digest of a text, null without words; the search for one ends at the first character of a word."""
    return F.when(F.col(f"`{text}`").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text_bytes(text))))


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id (16 bytes of a text's digest, null without words), key, samples (binary)."""
    rows = docs.select(_identity(text).alias("id"), F.col(f"`{key}`").alias("key"), text_bytes(text).alias("text"))

    def draw(batches):
        shingler = Shingler()
        for b in batches:
            out = []
            for raw in b.column("text").to_pylist():
                shingles = shingler(raw)
                out.append(b"".join(x.tobytes() for x in sample(shingles)) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("key"), pa.array(out, pa.binary())], names=["id", "key", "samples"]
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(released(draw), f"id binary, key {kind}, samples binary")


def _buckets(batches):
    for b in batches:
        ids, count = b.column("id"), len(b)
        raw = np.frombuffer(b"".join(b.column("samples").to_pylist()), dtype=np.uint8).reshape(count, -1)
        split = len(DEPTHS) * SAMPLES * 8
        keys = np.ascontiguousarray(raw[:, :split]).view(np.int64).reshape(count, len(DEPTHS), SAMPLES)
        signature = pa.array([x.tobytes() for x in raw[:, split:]], pa.binary())
        index = pa.array(np.repeat(np.arange(count), SAMPLES))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(keys[:, d].ravel()) for d in range(len(DEPTHS))), ids.take(index), signature.take(index)],
            names=["k0", "k1", "k2", "id", "signature"],
        )


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_SHARED = pa.schema([("bucket", pa.int64()), ("id", pa.binary()), ("signature", pa.binary())])


def _sides(pairs: pa.RecordBatch | None, rows: pa.RecordBatch | None) -> pa.RecordBatch:
    """Pairs, or rows of shared buckets, as a batch of both; the other side is null."""
    count = len(pairs if rows is None else rows)
    columns = [
        *(pairs.columns if pairs is not None else [pa.nulls(count, f.type) for f in _PAIR]),
        *(rows.columns if rows is not None else [pa.nulls(count, f.type) for f in _SHARED]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[*_PAIR.names, *_SHARED.names])


def _proposals(batches):
    """Pairs from sorted bucket rows, and the rows of buckets that several texts share; holds a window of the bucket at hand.

    The first and the last bucket of a partition may go on in the next one, so their rows are told even if they are alone.
    """
    least = int(AGREEMENT * SAMPLES)
    held: tuple[list, list, list] = ([], [], [])
    first = last = lone = None  # buckets of the partition's first and of the latest row; that row, if not told yet

    def pairs(ids, signatures):
        if len(ids) > 1:
            matrix = np.frombuffer(b"".join(signatures), dtype=np.uint8).reshape(len(ids), SAMPLES)
            for i, j in forest(matrix, least):
                yield min(ids[i], ids[j]), max(ids[i], ids[j])

    def told(found):
        return _sides(pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], schema=_PAIR), None)

    for b in batches:
        if not len(b):
            continue
        own = b.column("k0").to_numpy()
        rows = pa.RecordBatch.from_arrays([b.column("k0"), b.column("id"), b.column("signature")], schema=_SHARED)
        shared = np.r_[own[1:] == own[:-1], False] | np.r_[False, own[1:] == own[:-1]]
        if first is None:
            first = own[0]
        shared |= own == first
        if own[0] == last:
            shared |= own == last
            if lone is not None:
                yield _sides(None, lone)
        last, lone = own[-1], None if shared[-1] else rows.slice(len(rows) - 1)
        if shared.any():
            yield _sides(None, rows.filter(pa.array(shared)))
        bucket = np.r_[np.array(held[0], dtype=np.int64), own]
        ids, signatures = held[1] + b.column("id").to_pylist(), held[2] + b.column("signature").to_pylist()
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(bucket)]
        found = set()
        for s, e in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):
            if e - s > 1:
                for w in _windows(s, e):
                    found.update(pairs(ids[w], signatures[w]))
        s = int(starts[-1])
        while len(ids) - s > WINDOW:  # the bucket may go on in the next batch
            found.update(pairs(ids[s : s + WINDOW], signatures[s : s + WINDOW]))
            s += WINDOW // 2
        held = (bucket[s:].tolist(), ids[s:], signatures[s:])
        if found:
            yield told(found)
    if lone is not None:
        yield _sides(None, lone)
    found = set(pairs(held[1], held[2]))
    if found:
        yield told(found)


def _windows(start: int, end: int) -> Iterator[slice]:
    while True:
        yield slice(start, min(start + WINDOW, end))
        if start + WINDOW >= end:
            return
        start += WINDOW // 2


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of the sorted sets has in common with the first."""
    out, start = np.zeros(len(others), dtype=np.int64), 0
    sizes = np.array([len(x) for x in others])
    ends = np.cumsum(sizes)
    while start < len(others):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + LOOKED_UP, side="right")))
        members = np.concatenate(others[start:end])
        at = np.minimum(np.searchsorted(one, members), len(one) - 1)
        out[start:end] = np.add.reduceat(one[at] == members, np.r_[0, np.cumsum(sizes[start : end - 1])], dtype=np.int64)
        start = end
    return out


def _across(batches, similarity: float):
    """Links between texts of different classes from rows sorted by group (bucket, low, high).

    In a group of one block all texts meet, in a group of two those of one block meet those of the other. A pair is told in the
    bucket of the first sample that it shares; one whose classes links of the group have joined needs no link.
    """
    least = int(AGREEMENT * SAMPLES)
    group = ["bucket", "low", "high"]

    def links(rows: pa.Table):
        count, two = len(rows), rows["low"][0].as_py() != rows["high"][0].as_py()
        codes = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        if not codes.max():
            return
        own = rows["block"].to_numpy()
        order = np.argsort(own, kind="stable")
        own, codes, ids = own[order], codes[order].copy(), rows["id"].to_pylist()
        signatures = np.frombuffer(b"".join(rows["signature"].to_pylist()), dtype=np.uint8).reshape(count, SAMPLES)[order]
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), dtype=np.int64).reshape(count, SAMPLES)[order]
        sample_at = int(np.flatnonzero(keys[0] == rows["bucket"][0].as_py())[0])
        shingles = [np.frombuffer(x, np.uint32) for x in rows["shingles"].to_pylist()]
        sets: dict[int, np.ndarray] = {}

        def members(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.unique(shingles[order[i]])
            return sets[i]

        split = int(np.searchsorted(own, own[0], side="right")) if two else count - 1
        for i in range(split if not two or split < count else 0):
            start = split if two else i + 1
            agree = (signatures[start:] == signatures[i]).sum(axis=1, dtype=np.int8)
            hits = np.flatnonzero((agree >= least) & (codes[start:] != codes[i]))
            hits = hits[(keys[start + hits] == keys[i]).argmax(axis=1) == sample_at]
            if not len(hits):
                continue
            hits = start + hits[np.argsort(-agree[hits], kind="stable")]
            one, others = members(i), [members(j) for j in hits.tolist()]
            total = len(one) + np.array([len(x) for x in others])
            for j in hits[_common(one, others) >= similarity / (1 + similarity) * total - 1e-9].tolist():
                if codes[j] != codes[i] and verified(shingles[order[i]], shingles[order[j]], similarity):
                    codes[codes == codes[j]] = codes[i]
                    a, b = ids[order[i]], ids[order[j]]
                    yield (a, b) if a < b else (b, a)

    def told(rows: pa.Table):
        found = list(links(rows))  # fewer than rows
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], schema=_PAIR)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        if held:
            last = held[-1].slice(len(held[-1]) - 1, 1)
            if any(last.column(c)[0] != b.column(c)[0] for c in group):
                yield from told(pa.Table.from_batches(held))
                held = []
        marks = [b.column(c).to_numpy() for c in group]
        cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        start = 0
        for cut in cuts.tolist():
            yield from told(pa.Table.from_batches([*held, b.slice(start, cut - start)]))
            held, start = [], cut
        held.append(b.slice(start))
    if held:
        yield from told(pa.Table.from_batches(held))


def meet_again(docs: DataFrame, texts: DataFrame, shared: DataFrame, roots: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """a, b: links between texts of different classes that share a bucket and agree.

    ``shared``: bucket, id, signature of all texts of the buckets that hold several.
    """
    rooted = shared.join(roots, F.col("id") == F.col("member"), "left")
    rows = rooted.select("bucket", "id", F.coalesce("root", "id").alias("root"), "signature")
    mark = F.xxhash64("root")
    several = rows.groupBy("bucket").agg(F.min(mark).alias("least"), F.max(mark).alias("most"))
    several = materialise(several.filter("least <> most").select(F.col("bucket").alias("open")), "open-buckets")
    rows = materialise(rows.join(several, F.col("bucket") == F.col("open")).drop("open"), "open-rows")
    cuts = sequences(docs, texts, rows.select("id").distinct(), key, text, sets=False)
    size = F.octet_length("shingles").cast("long").alias("size")
    sizes = rows.join(cuts.select("id", size), "id").groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    sizes = materialise(sizes.select("bucket", blocks.alias("blocks")), "bucket-blocks")
    dealt = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "root", "signature"
    )
    keys = texts.select("id", F.substring("samples", 1, 8 * SAMPLES).alias("keys"))  # those of the first depth
    dealt = dealt.join(cuts.join(keys, "id"), "id")
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["bucket", "low", "high"]
    ordered = dealt.repartition(parts, *group).sortWithinPartitions(*group)
    return ordered.mapInArrow(released(lambda batches: _across(batches, similarity)), "a binary, b binary").distinct()


def closed(docs: DataFrame, texts: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """member, root of the classes of all texts. ``texts``: id, key (of one row of the text), samples."""
    told = materialise(windowed(texts), "windows")
    shared = told.filter("bucket is not null").select(*_SHARED.names)
    tried = materialise(told.filter("a is not null").select("a", "b").distinct(), "proposed")
    roots = components(verify(docs, texts, tried, key, text, similarity))
    links = materialise(meet_again(docs, texts, shared, roots, key, text, similarity), "met-links")
    return roots if links.isEmpty() else components(roots.toDF("a", "b").unionByName(links))


def windowed(texts: DataFrame) -> DataFrame:
    """a, b: pairs proposed by the forests of the windows of sorted buckets; bucket, id, signature: the rows of shared buckets."""
    rows = texts.select("id", "samples").mapInArrow(released(_buckets), "k0 long, k1 long, k2 long, id binary, signature binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["k0", "k1", "k2", "id"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(released(_proposals), "a binary, b binary, bucket long, id binary, signature binary")


def sequences(docs: DataFrame, texts: DataFrame, ids: DataFrame, key: str, text: str, sets: bool = True) -> DataFrame:
    """id, shingles and, with ``sets``, members (sorted, without repeats) of the texts with these ids; written once."""
    wanted = materialise(ids.join(texts.select("id", "key"), "id"), "wanted")  # of known size: few are broadcast, and no text is shuffled for them
    # By key first, so that only wanted texts are hashed; a key may be that of other texts too.
    keys = wanted.select(F.col("key").alias("want_key")).distinct()
    near = docs.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").alias("given"))
    near = near.join(keys, F.col("doc_key").eqNullSafe(F.col("want_key")), "left_semi")
    given = near.select(_identity("given").alias("id"), "doc_key", text_bytes("given").alias("text"))
    found = given.join(wanted.withColumnRenamed("id", "want"), (F.col("id") == F.col("want")) & F.col("doc_key").eqNullSafe(F.col("key")), "left_semi")

    def cut(batches):
        shingler = Shingler()
        for b in batches:
            told = [shingler(raw).astype(np.uint32) for raw in b.column("text").to_pylist()]
            columns = {"id": b.column("id"), "shingles": pa.array([x.tobytes() for x in told], pa.binary())}
            if sets:
                columns["members"] = pa.array([np.unique(x).tobytes() for x in told], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "id binary, shingles binary" + ", members binary" * sets
    return materialise(found.select("id", "text").mapInArrow(released(cut), schema).dropDuplicates(["id"]), "shingles")


def verify(docs: DataFrame, texts: DataFrame, proposed: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """Those of the pairs a, b of ids of texts that reach the similarity."""
    cuts = sequences(docs, texts, proposed.select(F.explode(F.array("a", "b")).alias("id")).distinct(), key, text)
    # Most pairs of a hot bucket have too little in common whatever the order: told by sorted sets before any alignment.
    sets = cuts.select("id", "members")
    alike = proposed.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b").mapInArrow(
        released(lambda batches: _alike(batches, similarity)), "a binary, b binary"
    )
    shingles = cuts.select("id", "shingles")
    pairs = alike.join(shingles.toDF("a", "one"), "a").join(shingles.toDF("b", "two"), "b")

    def check(batches):
        for b in batches:
            good = [
                verified(np.frombuffer(one, np.uint32), np.frombuffer(two, np.uint32), similarity)
                for one, two in zip(b.column("one").to_pylist(), b.column("two").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(released(check), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """member, root: the smallest id of the component, for every id but the roots. ``edges``: a, b."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, before = materialise(now, "stars"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = materialise(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "stars",
        )
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("member"), F.col("v").alias("root"))
        before = state


def classes(docs: DataFrame, key: str, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """key, class_id (smallest key of the class), kept (true for one text and key of each class), id: a row per row."""
    drawn = materialise(sketches(docs, key, text), "samples")
    words = drawn.filter("id is not null")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key")))
    texts = materialise(
        words.groupBy("id").agg(first.alias("low"), F.first("samples").alias("samples")).select("id", "low.key", "samples"),
        "texts",
    )
    roots = closed(docs, texts, key, text, similarity)
    rooted = texts.select("id", "key").join(roots, F.col("id") == F.col("member"), "left")
    rooted = rooted.select("id", "key", F.coalesce("root", "id").alias("root"))
    keepers = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("id").alias("id"))).alias("keep")
    )
    told = rooted.join(keepers, "root").select("id", F.col("keep.key").alias("class_id"), F.col("keep.id").alias("keep_id"))
    same = drawn.select("id", "key").join(told, "id", "left")
    lone = F.col("id").isNull()
    return same.select(
        F.col("key").alias(key),
        F.when(lone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        (lone | (F.col("id") == F.col("keep_id")) & F.col("key").eqNullSafe(F.col("class_id"))).alias("kept"),
        "id",
    )


def deduplicate(docs: DataFrame, key: str, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """All columns of one row of each class; rows without words stay. The text is moved once more, for rows that stay."""
    stay = classes(docs, key, text, similarity).filter("kept and id is not null").select("id", F.col(key).alias("key")).distinct()
    own, stay_id, stay_key = (fresh("own", "id", "key")[k] for k in ("own", "id", "key"))
    rows = docs.withColumn(own, _identity(text))
    stay = stay.toDF(stay_id, stay_key)
    same = (F.col(own) == F.col(stay_id)) & F.col(f"`{key}`").eqNullSafe(F.col(stay_key))
    one = rows.filter(F.col(own).isNotNull()).join(stay, same, "left_semi").dropDuplicates([own, key])
    return one.unionByName(rows.filter(F.col(own).isNull())).drop(own)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), "doc_id").drop("id")

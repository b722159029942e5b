"""Quartile bucket digests: fingerprints of texts that change little when the texts do.

Hashed byte triplets from a sliding window of five bytes are counted in 128 buckets. Each bucket is written as the quartile
of the counts that it falls in; a header holds the length on a log scale, the ratios of the quartiles and a checksum. The
difference of two digests is the sum of the differences of buckets and header fields, each bounded; likeness is one minus its
share of the largest possible difference.

Plan: documents are dealt in ranges of the id, so that a document and the next one meet in the same task; texts are
shuffled once. The last document of each range meets the first of the next in a small second step.

Cases: null or empty text, and fewer than three bytes: no triplets, all buckets 0. Equal texts have equal digests and likeness
1. Equal ids: ordered by a hash of the text, then by text. Null ids come first. A single document is its own next one. Repeated rows: each is fingerprinted.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.common import table, text_bytes
from leakscan.llm.ordered import following, in_order
from leakscan.session import materialise

BUCKETS = 128
#: Places in the window of each triplet.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Bytes that are hashed at a time, so that memory does not grow with a text.
STEP = 1 << 20
_FACTORS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
#: Largest differences of the length code and of each quartile ratio that count.
LENGTH_MOST, RATIO_MOST = 24, 12
#: Difference of two buckets by the distance of their quartiles; opposite ends count double.
BUCKET_STEPS = np.array([0, 1, 2, 6])
MOST = BUCKETS * 6 + LENGTH_MOST + 2 * RATIO_MOST


def bucket_counts(raw: bytes) -> np.ndarray:
    total = np.zeros(256, dtype=np.int64)
    for start in range(0, max(len(raw) - 2, 0), STEP):
        part = np.frombuffer(raw[start : start + STEP + 4], dtype=np.uint8).astype(np.uint32)
        scaled = [part * f for f in _FACTORS]
        for number, (a, b, c) in enumerate(TRIPLETS):
            n = min(len(part) - c, STEP)
            if n > 0:
                mixed = scaled[0][a : a + n] + scaled[1][b : b + n] + scaled[2][c : c + n]
                mixed += np.uint32(number * 0x9E3779B1 & 0xFFFFFFFF)
                mixed ^= mixed >> np.uint32(15)
                mixed *= np.uint32(2246822519)
                total += np.bincount((mixed >> np.uint32(24)).astype(np.uint8), minlength=256)
    return total[:BUCKETS]


def fingerprint(raw: bytes) -> str:
    """Eight hex digits of header (checksum, length code, two quartile ratios) and one for every two buckets."""
    counts = bucket_counts(raw)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(int(8 * math.log2(len(raw) + 1)), 0xFF)
    ratios = (min(16 * q1 // q3, 15), min(16 * q2 // q3, 15)) if q3 else (0, 0)
    head = bytes([zlib.crc32(raw) & 0xFF, length, ratios[0] << 4 | ratios[1], 0])
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return (head + packed.tobytes()).hex()


def _codes(digest: str) -> tuple[bytes, np.ndarray]:
    raw = bytes.fromhex(digest)
    packed = np.frombuffer(raw[4:], dtype=np.uint8)
    return raw[:4], np.stack([packed >> s & 3 for s in (0, 2, 4, 6)]).astype(np.int8)


def likeness(one: str, two: str) -> float:
    """1 for equal digests, 0 for digests as different as can be."""
    if one == two:
        return 1.0
    (head, codes), (head2, codes2) = _codes(one), _codes(two)
    difference = int(BUCKET_STEPS[np.abs(codes - codes2)].sum())
    difference += min(abs(head[1] - head2[1]), LENGTH_MOST)
    for shift in (4, 0):
        difference += min(abs((head[2] >> shift & 15) - (head2[2] >> shift & 15)), RATIO_MOST)
    return 1 - difference / MOST


def edited(text: str, following_text: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following_text[:half]


def _row(key, raw: bytes, digest: str, next_raw: bytes, next_digest: str) -> tuple:
    text = raw.decode("utf-8", "replace")
    changed = edited(text, next_raw.decode("utf-8", "replace")).encode()
    changed_digest = fingerprint(changed)
    return (
        key,
        len(text),
        hashlib.sha256(changed).hexdigest(),
        digest,
        changed_digest,
        likeness(digest, changed_digest),
        likeness(digest, next_digest),
    )


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    rows = in_order(docs.select(F.col(f"`{key}`").alias("key"), text_bytes(text).alias("text")), ["key"], long="text")
    kind = rows.schema["key"].dataType.simpleString()

    def walk(batches):
        """Rows with their next one; the first and last of a partition also as they are, with edge 0 and 1."""
        before = part = first = None
        for b in batches:
            keys, out, edges = b.column("key"), [], []
            for i, raw in enumerate(b.column("text").to_pylist()):
                now = (keys[i], raw, fingerprint(raw))
                if before is None:
                    part = b.column("part")[i].as_py()
                    edges.append((0, *now))
                else:
                    out.append(_row(*before, *now[1:]))
                before = now
            if out or edges:
                yield _batch(keys.type, part, out, edges)
            first = keys.type
        if before is not None:
            yield _batch(first, part, [], [(1, *before)])

    def _batch(key_type, part, out, edges):
        count, more = len(out), len(edges)
        keys = [r[0].as_py() for r in out] + [e[1].as_py() for e in edges]
        columns = list(zip(*(r[1:] for r in out), strict=True)) if out else [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None] * count + [e[0] for e in edges], pa.int32()),
                pa.array([part] * (count + more), pa.int32()),
                pa.array(keys, key_type),
                pa.array([None] * count + [e[2] for e in edges], pa.binary()),
                *(pa.array(list(c) + [None] * more, t) for c, t in zip(columns, _KINDS, strict=True)),
            ],
            names=["edge", "part", "key", "raw", *_NAMES],
        )

    walked = materialise(rows.mapInArrow(walk, f"edge int, part int, key {kind}, raw binary, {_COLUMNS}"), "digests")
    done = walked.filter("edge is null").select("key", *_NAMES)
    firsts = walked.filter("edge = 0").select(F.col("part").alias("next_part"), F.col("raw").alias("next_raw"))
    lasts = walked.filter("edge = 1").select("part", "key", "raw")
    order = following(lasts.select("part"), wrap=True)
    pairs = lasts.join(order, "part").join(firsts, "next_part").select("key", "raw", "next_raw")

    def close(batches):
        for b in batches:
            texts = zip(b.column("raw").to_pylist(), b.column("next_raw").to_pylist(), strict=True)
            out = [_row(None, one, fingerprint(one), two, fingerprint(two))[1:] for one, two in texts]
            columns = zip(*out, strict=True) if out else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), *(pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True))], names=["key", *_NAMES]
            )

    both = done.unionByName(pairs.mapInArrow(close, f"key {kind}, {_COLUMNS}"))
    return both.select(F.col("key").alias(key), *_NAMES)


def op7_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"), "doc_id")

"""Byte-level BPE by prefix dynamic programming, with exact decoding.

For every prefix of a split of the text the encoder stores the one token that ends its encoding. A token that is a suffix of the
prefix is that token if it and the last token of what comes before it form a valid pair, i.e. merging the bytes of the two
yields just these two. So bytes can be appended without starting over, and after an edit only the places from it on are
computed until the stored tokens agree again with what they were.

Plan: map-only. A task keeps bounded tables of the splits and pairs that it has met. Texts are encoded whole; where white
space is single, a text is looked up word by word.

Cases: null or empty text: no ids. Bytes without a token of their own raise (byte-level vocabularies have all 256). Repeated
rows: each is encoded by itself. Very long splits take time in proportion to their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.common import blocks, table, text_bytes

#: Entries beyond which a worker empties its tables of words, splits and token pairs; bytes that it encodes at a time.
WORDS, SPLITS, PAIRS, BLOCK = 400_000, 300_000, 1_000_000, 16_000_000
_RUN = re.compile(r"\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 token and number."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PairTable:
    """Which pairs of tokens stand side by side in some encoding, told from how the tokens were merged."""

    def __init__(self, ranks: dict[bytes, int], halves: tuple[list[int], list[int]] | None = None):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves = halves or self._split_all()
        left, right = self.halves
        self.joined = {left[t] << 32 | right[t]: t for t in self.token if left[t] >= 0}
        self.known: dict[int, bool] = {}  # pairs met so far
        # a trie of the tokens read backwards; those that merging their own bytes does not yield only stand for whole splits
        self.back: dict[int, int] = {}
        ends = {}
        for raw, t in ranks.items():
            if len(raw) == 1 or left[t] >= 0:
                node = 0
                for byte in reversed(raw):
                    node = self.back.setdefault(node << 8 | byte, len(self.back) + 1)
                ends[node] = t
        self.token_at = [ends.get(node, -1) for node in range(len(self.back) + 1)]

    def _split_all(self) -> tuple[list[int], list[int]]:
        """For every token the two that its last merge joins, -1 where there is none."""
        size = max(self.token) + 1
        left, right = [-1] * size, [-1] * size
        for rank, raw in self.token.items():
            if len(raw) > 1:
                parts = self.merge(raw, rank)
                if len(parts) == 2:
                    left[rank], right[rank] = parts
        return left, right

    def merge(self, raw: bytes, below: int = 1 << 40) -> list[int]:
        """Merges the adjacent pair of lowest rank, the first of equals, while that is less than ``below``."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def valid(self, one: int, two: int) -> bool:
        """Undoes the merges beside the boundary, latest first; none across it may come before one that is undone."""
        left, right = self.halves
        limit = 1 << 40
        while True:
            across = self.joined.get(one << 32 | two)
            if across is not None and across < limit:
                return False
            if right[one] >= 0 and (one > two or left[two] < 0):
                limit, one = one, right[one]
            elif left[two] >= 0:
                limit, two = two + 1, left[two]  # of equals the one on the left, across, comes first
            else:
                return True


class PrefixEncoder:
    """The encoding of a growing and changing byte string; ``last[i]`` is the last token of its first i + 1 bytes."""

    def __init__(self, pairs: PairTable, raw: bytes = b""):
        self.pairs, self.raw, self.last = pairs, b"", []
        self.append(raw)

    def _extend(self, start: int) -> None:
        """Stores the last tokens of all prefixes longer than ``start``: the longest suffix that pairs with what is before."""
        raw, last = self.raw, self.last
        back, token_at, known, valid = self.pairs.back.get, self.pairs.token_at, self.pairs.known, self.pairs.valid
        for end in range(start + 1, len(raw) + 1):
            at, node, found = end, 0, []
            while at:
                node = back(node << 8 | raw[at - 1])
                if node is None:
                    break
                at -= 1
                if token_at[node] >= 0:
                    found.append((at, token_at[node]))
            while found:
                at, token = found.pop()
                if not at:
                    break
                pair = last[at - 1] << 32 | token
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = valid(last[at - 1], token)
                if fits:
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")
            last.append(token)

    def append(self, more: bytes) -> None:
        start, self.raw = len(self.raw), self.raw + more
        self._extend(start)

    def restart(self, raw: bytes) -> None:
        """Goes on to another string; what its prefix has in common with the present one is kept."""
        same, bound = 0, min(len(raw), len(self.raw))
        while same < bound and raw[same] == self.raw[same]:
            same += 1
        del self.last[same:]
        self.raw = raw
        self._extend(same)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces bytes start to stop; returns how many places were computed anew.

        Beyond the new bytes it stops once as many places as the longest token has bytes are what they were, since all
        that a later place depends on is then unchanged.
        """
        old, whole = self.last, self.raw[:start] + new + self.raw[stop:]
        tail, longest = len(old) - stop, self.pairs.longest
        self.last, done = old[:start], start + len(new)
        self.raw = whole[:done]
        self._extend(start)
        while tail:
            step = min(longest, tail)
            self.raw = whole[: done + step]
            self._extend(done)
            same = self.last[done:] == old[len(old) - tail : len(old) - tail + step]
            done, tail = done + step, tail - step
            if same and step == longest:
                self.last += old[len(old) - tail :]
                break
        self.raw = whole
        return done - start

    def ids(self) -> list[int]:
        out, at, token = [], len(self.raw), self.pairs.token
        while at:
            out.append(self.last[at - 1])
            at -= len(token[out[-1]])
        return out[::-1]


class Codec:
    """Texts to ids and back; every match of the pattern is encoded by itself, one that is a token is that token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, halves=None):
        self.ranks = ranks
        self.pairs = PairTable(ranks, halves)
        self._pattern = regex.compile(pattern)
        self._splits: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Ids of words not met before. Their splits are encoded in order, so that common prefixes are encoded once."""
        find, splits, ranks = self._pattern.findall, self._splits, self.ranks
        cut = {w: find(w) for w in words}
        encoder = PrefixEncoder(self.pairs)
        for raw, split in sorted((s.encode(), s) for s in {s for found in cut.values() for s in found if s not in splits}):
            token = ranks.get(raw)
            if token is None:
                encoder.restart(raw)
                splits[split] = pack(f"<{len(ids := encoder.ids())}I", *ids)
            else:
                splits[split] = token.to_bytes(4, "little")
        self._words.update((w, b"".join(map(splits.__getitem__, found))) for w, found in cut.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self._words) > WORDS:
            self._words.clear()
        if len(self._splits) > SPLITS:
            self._splits.clear()
        if len(self.pairs.known) > PAIRS:
            self.pairs.known.clear()
        # a word keeps the space in front of it; runs of white space belong together and are not cut
        cut = [
            re.split(r"(?<=\S)(?= \S)", t) if _RUN.search(t) or t[:1].isspace() or t[-1:].isspace() else
            [t] if " " not in t else (first := t.partition(" ")) and [first[0], *map(" ".__add__, first[2].split(" "))]
            for t in texts
        ]
        self._learn({w for w in set().union(*cut) if w not in self._words})
        return [b"".join(map(self._words.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pairs.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, keep: list[str], ranks_file: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ids (binary, little-endian unsigned 32-bit) of every text."""
    return _coded(docs, keep, ranks_file, pattern, text, "ids binary", lambda codec, ids: [ids])


def _coded(docs, keep, ranks_file, pattern, text, columns, derive) -> DataFrame:
    ranks = read_ranks(ranks_file)
    shared = docs.sparkSession.sparkContext.broadcast({"make": (ranks, pattern, PairTable(ranks).halves)})
    kept = F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)))
    rows = docs.select(kept.alias("kept"), text_bytes(text).alias("text"))
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])

    def encode(batches):
        worker = shared.value  # lives as long as the worker, and with it the tables of the codec
        if "codec" not in worker:
            worker["codec"] = Codec(*worker["make"])
        codec = worker["codec"]
        for b in batches:
            texts = b.column("text").to_pylist()
            found = []
            for i, j in blocks(texts, BLOCK):
                ids = codec.encode([t.decode("utf-8", "replace") for t in texts[i:j]])
                found += [derive(codec, x) for x in ids]
            values = list(zip(*found, strict=True)) if found else [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [b.column("kept"), *(pa.array(v, f.type) for v, f in zip(values, schema, strict=True))],
                names=["kept", *schema.names],
            )

    out = rows.mapInArrow(encode, f"kept {rows.schema['kept'].dataType.simpleString()}, {columns}")
    return out.select(*(F.col(f"kept.k{i}").alias(k) for i, k in enumerate(keep)), *schema.names)


def digest_documents(docs: DataFrame, keep: list[str], ranks_file: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens, ids_sha256 and, from the ids decoded again, decoded_sha256."""

    def derive(codec: Codec, ids: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _coded(
        docs, keep, ranks_file, pattern, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", derive
    )


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(
        table(spark, sf_dir, "documents"),
        ["doc_id"],
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )

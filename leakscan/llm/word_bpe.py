"""Ids of a public word BPE for many words at a time.

The vocabulary's tokenizer drops white space and never merges across it, so a text's ids are those of its words one after
the other. Words of plain letters are merged together, all runs of one length in one numpy array, one merge of each
run per step; every other word goes through the tokenizers library itself. Both give the library's ids.
"""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import regex

#: Words from here on, and runs longer than this, are left to the library.
PLAIN_BELOW, LONGEST = "ɐ", 64
_NONE = np.int32(2**31 - 1)


#: Bytes that the tables of words and runs may take before they are emptied; Python's overhead for an entry.
TABLE_BYTES, _ENTRY = 220_000_000, 200


class WordBpe:
    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        self._suffix = model["model"]["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        first = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        second = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        keys = first << 32 | second
        order = np.argsort(keys)
        self._keys, self._rank = keys[order], order.astype(np.int32)
        self._merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        alphabet = _byte_characters()
        self._byte = np.array([[vocabulary[c], vocabulary[c + self._suffix]] for c in alphabet], dtype=np.int32)
        pattern = next(
            p["pattern"]["Regex"] for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self._runs = regex.compile(pattern)
        self._most, self._bytes, self._words, self._parts = table_bytes, 0, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self._bytes > self._most:
            self._words.clear()
            self._parts.clear()
            self._bytes = 0
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        self._learn({w for w in set().union(*cut) if w not in self._words})
        return [b"".join(map(self._words.__getitem__, words)) for words in cut]

    def _learn(self, words: set[str]) -> None:
        plain, other = {}, []
        for w in words:
            if w and (max(w) >= PLAIN_BELOW or not w.isprintable() or "İ" in w or "<|" in w):
                other.append(w)
            else:
                runs = self._runs.findall(w.lower())
                if any(len(r) > LONGEST // 2 for r in runs):
                    other.append(w)
                else:
                    plain[w] = runs
        for w, e in zip(other, self.library.encode_batch(other, add_special_tokens=False), strict=True):
            self._words[w] = np.array(e.ids, dtype="<u4").tobytes()
            self._bytes += 5 * len(w) + _ENTRY
        by_length = defaultdict(list)
        for run in {r for runs in plain.values() for r in runs if r not in self._parts}:
            raw = run.encode()
            by_length[len(raw)].append((run, raw))
        for length, pairs in by_length.items():
            self._bytes += len(pairs) * (5 * length + _ENTRY)
            step = max(1, 400_000 // length)
            for i in range(0, len(pairs), step):
                part = pairs[i : i + step]
                flat = np.frombuffer(b"".join(raw for _, raw in part), dtype=np.uint8).reshape(len(part), length)
                for rows, ids in self._merge(flat):
                    raw, width = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                    self._parts.update((part[r][0], raw[k * width : (k + 1) * width]) for k, r in enumerate(rows.tolist()))
        parts = self._parts
        self._bytes += sum(map(len, plain)) * 2 + len(plain) * _ENTRY
        self._words.update((w, b"".join(map(parts.__getitem__, runs))) for w, runs in plain.items())

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._rank[at], _NONE)

    def _merge(self, flat: np.ndarray):
        """Pairs of (rows, their ids) as rows come to an end; in each step all others do their first merge of lowest rank."""
        ids = self._byte[flat, 0]
        ids[:, -1] = self._byte[flat[:, -1], 1]
        rows = np.arange(len(ids))
        rank = self._ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.empty((len(ids), 0), np.int32)
        while len(rows):
            if not rank.shape[1]:
                yield rows, ids
                return
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            go = best != _NONE
            if not go.all():
                yield rows[~go], ids[~go]
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not len(rows):
                    return
            line = np.arange(len(rows))
            ids[line, at] = self._merged[best]
            places = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, places + (places > at[:, None]), axis=1)
            places = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, places + (places >= at[:, None]), axis=1)
            before, after = at > 0, at < rank.shape[1]
            l, a = line[before], at[before]
            rank[l, a - 1] = self._ranks(ids[l, a - 1], ids[l, a])
            l, a = line[after], at[after]
            rank[l, a] = self._ranks(ids[l, a], ids[l, a + 1])


def _byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(other)) for b in range(256)]

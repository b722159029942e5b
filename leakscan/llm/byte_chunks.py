"""Ids of a public byte-level BPE for many texts at a time, through a bounded table of the words met so far.

The vocabulary's tokenizer cuts a text before it merges, and no cut-out crosses a single space or line feed beside a character
that is not white space: the space goes with what follows, the line feed stands alone. So a text's ids are those of its words
one after the other, a word having the space or line feed in front of it, and each distinct word is encoded once. Texts with
other white space are cut at safe places only.

Words of common letters are encoded by tiktoken with the same merges as ranks, where ``faithful`` has shown that the two libraries
agree on the vocabulary; all others, and all words if they don't agree, by the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Bytes that the table of words may take before it is emptied; longer words are not kept.
TABLE_BYTES, LONGEST = 96_000_000, 1_000
#: Python's overhead for an entry: a key, a value and a place in the dictionary.
_ENTRY = 200
#: Words with a character from here on are left to the tokenizers library.
_PLAIN_BELOW = "ɐ"
#: In front of a text's first word, before which there is no space.
_FIRST = "\x1f"
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to share out
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ranks(path: str) -> dict[bytes, int] | None:
    """Tokens by rank, if the vocabulary's merges come in the order of the ids that they make."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
    other = iter(range(256, 512))
    byte = {chr(b) if b in set(kept) else chr(next(other)): b for b in range(256)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if made != sorted(set(made)):
        return None
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}


def _fast(ranks: dict[bytes, int]):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def faithful(path: str) -> bool:
    """Whether both libraries encode every token of the vocabulary alike; takes half a second, once per job."""
    ranks = _ranks(path)
    if ranks is None or len(ranks) < 256:
        return False
    tokens = [t for t in (raw.decode("utf-8", "ignore") for raw in ranks) if t and "<|" not in t]
    fast = _fast(ranks)
    return all(e.ids == fast(t) for t, e in zip(tokens, _library(path).encode_batch_fast(tokens, add_special_tokens=False), strict=True))


class _Odd(Exception):
    """A word that begins or ends with white space: the text can't be cut at every space."""


class ByteChunks:
    def __init__(self, path: str, fast: bool, table_bytes: int = TABLE_BYTES):
        self._path, self._whole, self._most = path, _library(path), table_bytes
        self._table = _Words(self._by_library, _fast(_ranks(path)) if fast else None)

    def _by_library(self, text: str) -> bytes:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if self._table.bytes > self._most:
            self._table.clear()
            self._table.bytes = 0
        words = (text.replace("\n", " \n") if "\n" in text else text).split(" ")
        words[0] = _FIRST + words[0]
        if _FIRST not in text:
            try:
                return b"".join(map(self._table.__getitem__, words))
            except _Odd:
                pass
        return b"".join(map(self._by_library, _SAFE.split(text)))


class _Words(dict):
    def __init__(self, slow, fast):
        self.slow, self.fast, self.bytes = slow, fast, 0

    def __missing__(self, key: str) -> bytes:
        if key[:1] == _FIRST:
            text = bare = key[1:]
        elif key[:1] == "\n":
            text, bare = key, key[1:]
        else:
            text, bare = " " + key, key
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise _Odd
        if self.fast and max(bare) < _PLAIN_BELOW and "<|" not in bare and bare.isprintable():
            ids = array("I", self.fast(text)).tobytes()
        else:
            ids = self.slow(text)
        if len(key) <= LONGEST:
            self[key] = ids
            self.bytes += len(key) + len(ids) + _ENTRY
        return ids

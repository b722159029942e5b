"""Segmentation lattices over a fixed piece vocabulary: all ways to cut a word into pieces, summed in log space.

The unit is a word with a leading space byte. Pieces hold a space only in front, so no piece crosses words and the lattice
of a text is the chain of those of its words. Words of equal length are worked on together, one numpy step for each
(start, piece length), so the cost of a word is a few microseconds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

NONE = -1


def public_pieces(model_file: str, lower: bool = True) -> list[bytes]:
    """The pieces of a public sentencepiece vocabulary as bytes, in vocabulary order, every single byte among them.

    Pieces that cannot occur in a word with a leading space are left out: control pieces, pieces with more than one space
    mark, and, with ``lower``, pieces with A-Z.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    seen: dict[bytes, None] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        if b" " not in raw[1:] and not (lower and raw != raw.lower() and len(raw) > 1):
            seen.setdefault(raw)
    return list(seen)


class Lattice:
    """A byte trie over the pieces; small as state(), a dense table once it is used."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for number, piece in enumerate(pieces):
            at = 0
            for byte in piece:
                at = nodes.setdefault((at, byte), len(nodes) + 1)
            ends[at] = number
        self._edges = np.array([(a, b, to) for (a, b), to in nodes.items()], dtype=np.int32)
        self._piece = np.full(len(nodes) + 1, NONE, dtype=np.int32)
        self._piece[list(ends)] = list(ends.values())
        self._table = None

    def state(self) -> tuple:
        """Plain arrays, for a broadcast."""
        return self.size, self.longest, self._edges, self._piece

    @classmethod
    def of(cls, state: tuple) -> Lattice:
        self = cls.__new__(cls)
        self.size, self.longest, self._edges, self._piece = state
        self._table = None
        return self

    def _dense(self) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros((len(self._piece), 256), dtype=np.int32)
            self._table[self._edges[:, 0], self._edges[:, 1]] = self._edges[:, 2]
        return self._table

    def groups(self, words: list[bytes], cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in the list, byte matrix with one row per place) for words of one length, few enough at a time."""
        by_length = defaultdict(list)
        for i, word in enumerate(words):
            by_length[len(word)].append(i)
        for length, index in by_length.items():
            step = max(1, cells // (length + 1))
            for k in range(0, len(index), step):
                part = index[k : k + step]
                flat = np.frombuffer(b"".join(b" " + words[i] for i in part), dtype=np.uint8)
                yield np.array(part), flat.reshape(len(part), length + 1).T

    def _walk(self, matrix: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | None, np.ndarray]]:
        """(start, end, words concerned or None for all, piece) for every place where a piece fits, starts in order."""
        table, piece_of = self._dense(), self._piece
        length, count = matrix.shape
        for start in range(length):
            state = table[0, matrix[start]]
            rows = None
            for end in range(start + 1, min(length, start + self.longest) + 1):
                if end > start + 1:
                    cell = matrix[end - 1] if rows is None else matrix[end - 1, rows]
                    state = table[state, cell]
                live = state > 0
                if not live.all():
                    rows = np.flatnonzero(live) if rows is None else rows[live]
                    state = state[live]
                    if not len(state):
                        break
                piece = piece_of[state]
                fits = piece >= 0
                if fits.all():
                    yield start, end, rows, piece
                elif fits.any():
                    yield start, end, np.flatnonzero(fits) if rows is None else rows[fits], piece[fits]

    def log_probability(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations; weights: log probabilities, pieces or pieces x models.

        Forward recursion. Every byte is a piece, so each word has a segmentation; an empty word is the space alone.
        """
        wide = weights if weights.ndim == 2 else weights[:, None]
        out = np.empty((len(words), wide.shape[1]))
        for index, matrix in self.groups(words):
            forward = self._forward(matrix, wide, self._walk(matrix))
            out[index] = forward[-1]
        return out if weights.ndim == 2 else out[:, 0]

    @staticmethod
    def _forward(matrix: np.ndarray, wide: np.ndarray, steps) -> np.ndarray:
        length, count = matrix.shape
        forward = np.full((length + 1, count, wide.shape[1]), -np.inf)
        forward[0] = 0
        for start, end, rows, piece in steps:
            if rows is None:
                forward[end] = np.logaddexp(forward[end], forward[start] + wide[piece])
            else:
                forward[end, rows] = np.logaddexp(forward[end, rows], forward[start, rows] + wide[piece])
        return forward

    def expected(self, words: list[bytes], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected piece counts over all segmentations of counted words (forward-backward)."""
        total = np.zeros(self.size)
        for index, matrix in self.groups(words, 100_000):
            steps = list(self._walk(matrix))
            forward = self._forward(matrix, weights[:, None], steps)[:, :, 0]
            length, count = matrix.shape
            backward = np.full((length + 1, count), -np.inf)
            backward[length] = 0
            weight = counts[index]
            for start, end, rows, piece in reversed(steps):
                at = slice(None) if rows is None else rows
                share = weights[piece] + backward[end, at]
                backward[start, at] = np.logaddexp(backward[start, at], share)
                mass = np.exp(share + forward[start, at] - forward[length, at]) * weight[at]
                total += np.bincount(piece, mass, self.size)
        return total

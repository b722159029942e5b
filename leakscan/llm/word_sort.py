"""Words of an Arrow buffer brought into order by sorting pointers, not strings.

A pointer is the place where a word starts. Pointers are sorted by multikey quicksort whose "character" is eight bytes: a slice is
split three ways by a pivot, the smaller and larger pointers are sorted on by the same eight bytes, the equal ones by the next
eight. Slices that have become small are put in order together, one numpy call for all of a depth. The sort is stable, so equal
words stay in the order of the buffer.
"""

from __future__ import annotations

import numpy as np

#: Slices up to this many pointers are no longer split by pivots.
SMALL = 4096
#: Bytes of a word from which on equal prefixes are compared as whole words.
DEEP = 64
#: Keeps the first k of eight bytes.
_MASKS = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(9)], dtype=np.uint64)

# A-Z as a-z, other letters and every byte of a character beyond ASCII as they are, all else 0.
FOLD = np.zeros(256, dtype=np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes with eight zeros behind, starts, lengths) of the words of all texts; no word spans two texts."""
    folded = np.zeros(len(data) + 8, dtype=np.uint8)
    folded[: len(data)] = FOLD[data]
    letter = folded[: len(data) + 1] != 0
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = offsets[offsets < len(data)]
    first[edges] |= letter[edges]
    last = letter[:-1].copy()  # a letter whose successor starts a word or is none
    last &= ~letter[1:] | first[1:]
    starts = np.flatnonzero(first)
    return folded, starts, np.flatnonzero(last) - starts + 1


class PointerSort:
    """Order of words given by start and length, and where in it a new word begins."""

    def __init__(self, folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.folded, self.starts, self.lengths = folded, starts, lengths
        self.eight = np.ndarray((len(folded) - 7,), dtype=">u8", buffer=folded, strides=(1,))
        self.order = np.arange(len(starts))
        self.new = np.zeros(len(starts), dtype=bool)
        self.new[:1] = True
        self._sort()

    def _keys(self, pointers: np.ndarray, depth: int) -> np.ndarray:
        """Bytes depth to depth + 8 of each word; beyond its end zeros, which no word holds."""
        left = self.lengths[pointers] - depth
        at = np.minimum(self.starts[pointers] + depth, len(self.eight) - 1)
        return self.eight[at].astype(np.uint64) & _MASKS[np.clip(left, 0, 8)]

    def _sort(self) -> None:
        slices, depth = [(0, len(self.order))], 0
        while slices and depth < DEEP:
            slices = self._one_depth([s for s in slices if s[1] - s[0] > 1], depth)
            depth += 8
        for low, high in slices:
            self._whole(low, high)

    def _one_depth(self, slices: list[tuple[int, int]], depth: int) -> list[tuple[int, int]]:
        """Orders the slices by eight bytes; the slices of pointers that are equal in them and go on."""
        equal, small = [], []
        stack = []
        for low, high in slices:
            if high - low <= SMALL:
                small.append((low, high))
            else:
                stack.append((low, high, self._keys(self.order[low:high], depth)))
        while stack:
            low, high, key = stack.pop()
            if high - low <= SMALL:
                small.append((low, high))
                continue
            sample = np.sort(key[:: max(1, len(key) // 9)])
            pivot = sample[len(sample) // 2]
            less, more = key < pivot, key > pivot
            same = ~(less | more)
            mine = self.order[low:high].copy()
            a, b = low + int(less.sum()), high - int(more.sum())
            self.order[low:a], self.order[a:b], self.order[b:high] = mine[less], mine[same], mine[more]
            self.new[[x for x in (a, b) if x < high]] = True
            if pivot & np.uint64(0xFF):
                equal.append((a, b))
            stack += [(low, a, key[less]), (b, high, key[more])]
        return equal + self._finish([s for s in small if s[1] - s[0] > 1], depth)

    def _finish(self, small: list[tuple[int, int]], depth: int) -> list[tuple[int, int]]:
        """Orders many small slices at a time."""
        if not small:
            return []
        lows, highs = (np.array(x) for x in zip(*small, strict=True))
        sizes = highs - lows
        slot = np.repeat(np.arange(len(lows)), sizes)
        place = np.arange(len(slot)) + np.repeat(lows - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        mine = self.order[place]
        key = self._keys(mine, depth)
        by = np.lexsort((key, slot))
        key, mine = key[by], mine[by]
        self.order[place] = mine
        step = np.ones(len(place), dtype=bool)
        step[1:] = (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])
        self.new[place[step]] = True
        begin = np.flatnonzero(step)
        count = np.diff(np.append(begin, len(step)))
        on = (count > 1) & ((key[begin] & np.uint64(0xFF)) != 0)
        return list(zip(place[begin[on]].tolist(), (place[begin[on]] + count[on]).tolist(), strict=True))

    def _whole(self, low: int, high: int) -> None:
        """Orders words with a long common beginning as strings; there are few of them."""
        mine = self.order[low:high]
        words = [self.word(p) for p in mine]
        by = sorted(range(len(words)), key=words.__getitem__)
        self.order[low:high] = mine[by]
        for k in range(1, len(by)):
            if words[by[k]] != words[by[k - 1]]:
                self.new[low + k] = True

    def word(self, pointer: int) -> bytes:
        return self.folded[self.starts[pointer] : self.starts[pointer] + self.lengths[pointer]].tobytes()

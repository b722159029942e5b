"""Longest common subsequences: by bit-parallel rows (a Python integer holds one row of the alignment table), or by equal pairs."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np


def _places(items: Sequence) -> dict:
    masks: dict = {}
    for i, x in enumerate(items):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common_lines(one: Sequence, two: Sequence) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    shared = set(one) & set(two)
    left = [i for i, x in enumerate(one) if x in shared]
    right = [j for j, x in enumerate(two) if x in shared]
    masks, row, full = _places([two[j] for j in right]), (1 << len(right)) - 1, (1 << len(right)) - 1
    rows = []
    for i in left:
        fits = row & masks[one[i]]
        row = ((row + fits) | (row - fits)) & full
        rows.append(row)
    i, j, pairs = len(left), len(right), []
    while i and j:
        if one[left[i - 1]] == two[right[j - 1]]:
            i, j = i - 1, j - 1
            pairs.append((left[i], right[j]))
        elif rows[i - 1] >> (j - 1) & 1:  # the last item of ``two`` adds nothing
            j -= 1
        else:
            i -= 1
    return pairs[::-1]


#: Pairs of equal items for each item up to which subsequences are found by pairs, beyond by rows of bits.
FEW = 8


def banded_common(one: Sequence, two: Sequence, band: int) -> int:
    """Length of a longest common subsequence that pairs only items at most ``band`` places apart.

    That is the whole subsequence wherever the two have at most ``band`` items that are not common. Memory is linear in the
    items: where items are mostly distinct, a longest rising run over the places of equal items, otherwise a row of bits.
    """
    places: dict = {}
    for j, x in enumerate(two):
        places.setdefault(x, []).append(j)

    def near(i: int, x) -> list[int]:
        found = places.get(x, ())
        if len(found) < 2:
            return [j for j in found if abs(i - j) <= band]
        return found[bisect_left(found, i - band) : bisect_right(found, i + band)]

    pairs = 0
    for i, x in enumerate(one):
        found = places.get(x)
        if found:
            pairs += bisect_right(found, i + band) - bisect_left(found, i - band)
    if pairs > FEW * (len(one) + len(two)):
        return _by_bits(one, len(two), band, near)
    ends: list[int] = []  # the smallest place at which a common subsequence of each length ends
    for i, x in enumerate(one):
        for j in reversed(near(i, x)):
            at = bisect_left(ends, j)
            ends[at : at + 1] = [j]
    return len(ends)


def _by_bits(one: Sequence, size: int, band: int, near) -> int:
    """The same by bit-parallel rows; a bit is unset where a common subsequence ends that is longer by one."""
    row = (1 << size) - 1
    for i, x in enumerate(one):
        low, high = max(0, i - band), min(size, i + band + 1)
        if low >= size:
            break
        found = near(i, x)
        if not found:
            continue
        flags = np.zeros(high - low, dtype=np.uint8)
        flags[np.array(found) - low] = 1
        span = (1 << high - low) - 1
        bits = row >> low & span
        fits = bits & int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        if fits:
            row ^= (bits ^ ((bits + fits) | (bits - fits)) & span) << low
    return size - row.bit_count()

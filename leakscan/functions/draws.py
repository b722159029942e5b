"""Repeatable pseudo-random draws: a function of key, seed and salt, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, seed: int, salt: str = "") -> Column:
    """Uniform in [0, 1): the first 32 bits of an MD5 digest. The same text gives the same draw in any SQL engine."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def weighted_choice(u: Column, weights: Mapping[str, float]) -> Column:
    """Value whose cumulative weight first exceeds the draw; weights need not sum to one.

    Whole-number weights become a list with repeats, so that the draw is evaluated once.
    """
    if all(isinstance(w, int) for w in weights.values()):
        return choice(u, [v for v, w in weights.items() for _ in range(w)])
    total = float(sum(weights.values()))
    running, expr = 0.0, None
    *head, (last, _) = weights.items()
    for value, weight in head:
        running += weight
        hit = u < F.lit(running / total)
        expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
    return F.lit(last) if expr is None else expr.otherwise(F.lit(last))


def choice(u: Column, values: Sequence) -> Column:
    """Evenly drawn element of a list of plain values; the draw is evaluated once."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int"))


def randint(u: Column, low: int, high: int) -> Column:
    """Whole number in [low, high]."""
    return (F.floor(u * F.lit(float(high - low + 1))) + F.lit(low)).cast("long")

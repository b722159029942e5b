"""K-means with all restarts at once: the centres of every restart are updated by one pass and one aggregation per round.

Each task holds its batches against the centres of all restarts and keeps one sum, count and cost per centre, so what is
shuffled depends on restarts, centres, width and tasks, never on rows. The driver holds centres and candidates only.

Starts are drawn by oversampling: a first vector, then rounds that draw each vector with a probability in proportion to its
squared distance from the candidates so far; candidates are weighted by the rows nearest to them and reduced to the wanted
number on the driver. Draws are functions of the vector, seed, restart and round, so equal vectors are drawn together and count
as one candidate: a vector that a third of all rows repeat is one row on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates that a round of drawing expects, as a multiple of the centres, and such rounds.
OVERSAMPLE, DRAWS = 2, 3
#: Rows held against the centres at a time.
_ROWS = 4096


@dataclass(frozen=True)
class Centres:
    """The cheapest of the restarts, the costs of all of them, and the number of passes over the vectors."""

    centres: np.ndarray
    cost: float
    costs: tuple[float, ...]
    passes: int


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    squares = (rows * rows).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :]
    return np.maximum(squares - 2 * rows @ centres.T, 0.0)


def _parts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for start in range(0, len(batch), _ROWS):
        yield _matrix(batch.column(0).slice(start, _ROWS))


def _sums(vectors: DataFrame, models: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Per model: sums of the vectors nearest to each centre, their numbers, and the cost. One pass."""
    starts = np.cumsum([0, *map(len, models)])
    stacked = np.concatenate(models)
    width = stacked.shape[1]

    def add(batches):
        sums, counts, costs = np.zeros_like(stacked), np.zeros(len(stacked), dtype=np.int64), np.zeros(len(stacked))
        for b in batches:
            for rows in _parts(b):
                distances = _distances(rows, stacked)
                for low, high in zip(starts[:-1], starts[1:], strict=True):
                    own = distances[:, low:high]
                    nearest = own.argmin(axis=1)
                    member = np.zeros((high - low, len(rows)))
                    member[nearest, np.arange(len(rows))] = 1
                    sums[low:high] += member @ rows
                    counts[low:high] += np.bincount(nearest, minlength=high - low)
                    costs[low:high] += np.bincount(nearest, own[np.arange(len(rows)), nearest], minlength=high - low)
        used = np.flatnonzero(counts)
        values = [np.r_[sums[i], costs[i]].tolist() for i in used]
        columns = [pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), pa.array(values, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", "sums"])

    told = vectors.mapInArrow(add, "slot int, n long, sums array<double>")
    added = told.select("slot", "n", F.posexplode("sums").alias("pos", "value")).groupBy("slot", "pos")
    rows = added.agg(F.sum("n").alias("n"), F.sum("value").alias("value")).toArrow()
    sums, counts = np.zeros((len(stacked), width + 1)), np.zeros(len(stacked), dtype=np.int64)
    slot, pos = rows["slot"].to_numpy(), rows["pos"].to_numpy()
    sums[slot, pos] = rows["value"].to_numpy()
    counts[slot] = rows["n"].to_numpy()
    cut = list(zip(starts[:-1], starts[1:], strict=True))
    return [sums[a:b, :-1] for a, b in cut], [counts[a:b] for a, b in cut], [float(sums[a:b, -1].sum()) for a, b in cut]


def _drawn(vectors: DataFrame, models: list[np.ndarray], costs: list[float], expected: float, seed: int, turn: int) -> list[np.ndarray]:
    """New candidates of each model. One pass; equal vectors are one candidate."""
    rate = [expected / c if c > 0 else 0.0 for c in costs]
    dice = [F.xxhash64("v", F.lit(f"{seed}-{m}-{turn}")).alias(f"d{m}") for m in range(len(models))]

    def draw(batches):
        for b in batches:
            at = 0
            for rows in _parts(b):
                for m, centres in enumerate(models):
                    bits = b.column(m + 1).slice(at, len(rows)).to_numpy(zero_copy_only=False)
                    chance = (bits.view(np.uint64) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                    hits = np.flatnonzero(chance < rate[m] * _distances(rows, centres).min(axis=1))
                    if len(hits):
                        columns = [pa.array([m] * len(hits), pa.int32()), pa.array(rows[hits].tolist(), pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["model", "v"])
                at += len(rows)

    found = vectors.select("v", *dice).mapInArrow(draw, "model int, v array<double>").distinct().orderBy("model", "v").collect()
    new: list[list] = [[] for _ in models]
    for row in found:
        new[row["model"]].append(row["v"])
    return [np.concatenate([c, np.array(n)]) if n else c for c, n in zip(models, new, strict=True)]


def _reduced(candidates: np.ndarray, weights: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """At most ``k`` of the weighted candidates, each drawn in proportion to weight times squared distance from those before."""
    weights = np.maximum(weights.astype(np.float64), 1e-9)
    chosen = [int(draw.choice(len(candidates), p=weights / weights.sum()))]
    near = _distances(candidates, candidates[chosen])[:, 0]
    while len(chosen) < k:
        share = weights * near
        share[chosen] = 0
        if share.sum() <= 0:
            break
        chosen.append(int(draw.choice(len(candidates), p=share / share.sum())))
        near = np.minimum(near, _distances(candidates, candidates[chosen[-1:]])[:, 0])
    return candidates[chosen]


def fit_restarts(
    df: DataFrame,
    k: int = 10,
    seed: int = 42,
    n_init: int = 10,
    vector: str = "embedding",
    max_iter: int = 20,
    tolerance: float = 1e-4,
) -> Centres:
    """The centres of lowest cost among ``n_init`` restarts, all of which are updated together.

    Null vectors and those with a component that is null or not finite are left out. Fewer distinct vectors than ``k`` give
    fewer centres. A centre without rows stays. An empty table is an error. A restart ends with the round in
    which none of its centres moves more than ``tolerance``.
    """
    held = df.select(F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = held.filter(F.col("v").isNotNull() & sound)
    firsts = vectors.agg(*[F.min_by("v", F.struct(F.xxhash64("v", F.lit(f"{seed}-{m}")), "v")).alias(f"m{m}") for m in range(n_init)]).first()
    if firsts is None or firsts["m0"] is None:
        raise ValueError("no vectors to cluster")
    models = [np.array([firsts[f"m{m}"]]) for m in range(n_init)]
    passes = 1
    for turn in range(DRAWS):
        _, _, costs = _sums(vectors, models)
        models = _drawn(vectors, models, costs, OVERSAMPLE * k, seed, turn)
        passes += 2
    _, weights, _ = _sums(vectors, models)
    passes += 1
    models = [_reduced(c, w, k, np.random.default_rng([seed, m])) for m, (c, w) in enumerate(zip(models, weights, strict=True))]
    moving = [True] * n_init
    for _ in range(max_iter):
        going = [m for m in range(n_init) if moving[m]]
        if not going:
            break
        sums, counts, _ = _sums(vectors, [models[m] for m in going])
        passes += 1
        for m, s, c in zip(going, sums, counts, strict=True):
            moved = np.where(c[:, None] > 0, s / np.maximum(c, 1)[:, None], models[m])
            moving[m] = bool((((moved - models[m]) ** 2).sum(axis=1) > tolerance**2).any())
            models[m] = moved
    _, _, costs = _sums(vectors, models)
    best = int(np.argmin(costs))
    return Centres(models[best], costs[best], tuple(costs), passes + 1)


def assign(df: DataFrame, centres: np.ndarray, vector: str = "embedding", into: str = "cluster") -> DataFrame:
    """Adds the number of the nearest centre, the smaller one on ties; null for a null vector. One pass, nothing is shuffled."""
    parts = [
        F.aggregate(
            F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)),
            F.lit(0.0),
            lambda total, x: total + x,
        )
        for c in centres
    ]
    ranked = F.array(*[F.struct(d.alias("distance"), F.lit(i).alias("at")) for i, d in enumerate(parts)])
    return df.withColumn(into, F.when(F.col(vector).isNotNull(), F.array_min(ranked)["at"]))

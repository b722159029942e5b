"""Boosted multiclass trees with class probabilities.

Softmax boosting: each round fits one regression tree per class to the gradients of the log loss, and the trees of all classes
grow a level at a time together. A level is one pass: tasks add up gradients and second derivatives per (class, node, feature,
bin), Spark adds up those of the tasks, and the driver, which gets sums as large as the model and no larger, picks the splits.
Gradients are whole multiples of a small unit, so sums, and with them the trees, do not depend on how rows are partitioned or on
tasks that were run again.

Features are binned once: a fine grid over each feature's range is counted, and bins of about equal counts are read off it. Rows
then are a few bytes each, written to the shared folder. Every ``REFRESH`` rounds they are written again with the margins that the
trees so far give, so that a pass evaluates only the trees since then.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.session import materialise

# Functions travel to the executors by value, so that these need not have the package; broadcasts hold arrays only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of the grid that a feature's bins are read off; rounds after which margins are written.
GRID, REFRESH = 1024, 10
#: Gradients are rounded to this unit; a long then holds the sum over some 10**12 rows.
_UNIT = 2.0**-22


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 30
    depth: int = 3
    bins: int = 32
    rate: float = 0.2
    penalty: float = 1.0
    least: float = 1.0  # second derivatives that either side of a split needs


class Trees:
    """Complete binary trees as arrays (rounds x classes x nodes): feature or -1, bin that still goes left, value."""

    def __init__(self, classes: int, depth: int):
        self.depth, shape = depth, (0, classes, 2 ** (depth + 1) - 1)
        self.feature, self.cut, self.value = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape)

    def state(self) -> tuple:
        return self.depth, self.feature, self.cut, self.value

    @classmethod
    def of(cls, state: tuple) -> Trees:
        self = cls.__new__(cls)
        self.depth, self.feature, self.cut, self.value = state
        return self

    def add(self) -> None:
        """A round of trees that are leaves of value 0."""
        one = (1, *self.feature.shape[1:])
        self.feature = np.concatenate([self.feature, np.full(one, -1, np.int32)])
        self.cut, self.value = np.concatenate([self.cut, np.zeros(one, np.int32)]), np.concatenate([self.value, np.zeros(one)])

    def nodes(self, bins: np.ndarray, r: int, k: int) -> np.ndarray:
        """Node of the tree that each row (rows x features, bins) comes to."""
        feature, cut = self.feature[r, k], self.cut[r, k]
        at, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            asked = feature[at]
            right = bins[row, np.maximum(asked, 0)] > cut[at]
            at = np.where(asked >= 0, 2 * at + 1 + right, at)
        return at

    def margins(self, bins: np.ndarray, start: np.ndarray, since: int, upto: int) -> np.ndarray:
        out = start.copy()
        for r in range(since, upto):
            for k in range(out.shape[1]):
                out[:, k] += self.value[r, k][self.nodes(bins, r, k)]
        return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _to_bins(features: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(features.shape, dtype=np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, features[:, j], side="left")
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(column), width)


def _edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Upper edges of all but the last bin of each feature; rows: ``x`` (array of doubles)."""

    def ends(batches):
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for b in batches:
            x = _matrix(b.column("x"), width)
            if len(x):
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high)], names=["f", "low", "high"])

    spread = rows.select("x").mapInArrow(ends, "f int, low double, high double").groupBy("f").agg(F.min("low"), F.max("high")).collect()
    low, high = np.zeros(width), np.zeros(width)
    for f, a, b in spread:
        if a <= b:
            low[f], high[f] = a, b
    step = np.where(high > low, (high - low) / GRID, 1.0)

    def count(batches):
        n = np.zeros((width, GRID), dtype=np.int64)
        for b in batches:
            x = _matrix(b.column("x"), width)
            cell = np.clip(((x - low) / step).astype(np.int64), 0, GRID - 1)
            n += np.bincount((cell + np.arange(width) * GRID).ravel(), minlength=width * GRID).reshape(width, GRID)
        f, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(f.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(n[f, cell])], names=["f", "cell", "n"]
        )

    n = np.zeros((width, GRID), dtype=np.int64)
    for f, cell, rows_there in rows.select("x").mapInArrow(count, "f int, cell int, n long").groupBy("f", "cell").agg(F.sum("n")).collect():
        n[f, cell] = rows_there
    out = []
    for f in range(width):
        full = np.flatnonzero(n[f])
        if len(full) > bins:
            share = np.cumsum(n[f]) * bins // max(1, n[f].sum())
            full = np.flatnonzero(np.diff(np.concatenate([[0], share])) > 0)
        out.append(low[f] + (full[:-1] + 1) * step[f] if len(full) else np.zeros(0))
    return [e[: bins - 1] for e in out]


def _best_splits(g: np.ndarray, h: np.ndarray, params: BoostParams) -> tuple[float, int, int]:
    """(gain, feature, last bin of the left side) of a node from sums (features x bins); ties: the first feature and bin."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    total_g, total_h = g[0].sum(), h[0].sum()
    right_g, right_h = total_g - left_g, total_h - left_h
    score = lambda a, b: a * a / (b + params.penalty)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)
    gain[(left_h < params.least) | (right_h < params.least)] = -np.inf
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def _probabilities(features: np.ndarray, edges: list[np.ndarray], start: np.ndarray, trees: Trees) -> np.ndarray:
    bins = _to_bins(np.nan_to_num(features), edges)
    return softmax(trees.margins(bins, np.tile(start, (len(bins), 1)), 0, len(trees.feature)))


class BoostedModel:
    """Fitted trees; adds prediction, probabilities and the predicted label to a table with a ``features`` vector."""

    def __init__(self, labels: list[str], edges: list[np.ndarray], start: np.ndarray, trees: Trees, gain: np.ndarray, params: BoostParams):
        self.labels, self.edges, self.start, self.trees, self.gain, self.params = labels, edges, start, trees, gain, params

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return _probabilities(features, self.edges, self.start, self.trees)

    def transform(self, df: DataFrame, target: str, predicted: str, features: str = "features") -> DataFrame:
        """Adds ``<target>_probability`` (vector), ``<target>_prediction`` (index) and ``predicted`` (label)."""
        shared = df.sparkSession.sparkContext.broadcast((self.edges, self.start, self.trees.state()))
        width = len(self.edges)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def tell(column: pd.Series) -> pd.Series:
            if not len(column):
                return pd.Series([], dtype=object)
            edges, start, state = shared.value
            return pd.Series(list(_probabilities(np.vstack(column.to_numpy()).reshape(-1, width), edges, start, Trees.of(state))))

        probability, held = f"{target}_probability", f"_{target}_p"
        out = df.withColumn(held, tell(vector_to_array(F.col(features))))
        best = F.array_position(held, F.array_max(held)) - 1
        names = F.array(*[F.lit(x) for x in self.labels])
        out = out.withColumn(f"{target}_prediction", best.cast("double")).withColumn(predicted, F.get(names, best.cast("int")))
        return out.withColumn(probability, array_to_vector(F.col(held))).drop(held)

    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        return self.gain / self.gain.sum() if self.gain.sum() else self.gain

    def save(self, spark: SparkSession, path: str) -> None:
        t = self.trees
        state = {
            "labels": self.labels, "edges": [e.tolist() for e in self.edges], "start": self.start.tolist(), "gain": self.gain.tolist(),
            "depth": t.depth, "feature": t.feature.tolist(), "cut": t.cut.tolist(), "value": t.value.tolist(), "params": vars(self.params),
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        s = json.loads(spark.read.parquet(path).first()["state"])
        trees = Trees(len(s["labels"]), s["depth"])
        trees.feature, trees.cut = np.array(s["feature"], np.int32), np.array(s["cut"], np.int32)
        trees.value = np.array(s["value"])
        return cls(s["labels"], [np.array(e) for e in s["edges"]], np.array(s["start"]), trees, np.array(s["gain"]), BoostParams(**s["params"]))


def fit_boosted(df: DataFrame, label: str, params: BoostParams = BoostParams(), weight: str | None = None, features: str = "features") -> BoostedModel:
    """Trees for the classes of ``label``; rows without a label or with a weight of nothing are left out."""
    spark = df.sparkSession
    rows = df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        vector_to_array(F.col(features)).alias("x"),
    )
    rows = materialise(rows.filter("w > 0"), "boost-rows")
    sums = {r["label"]: r["w"] for r in rows.groupBy("label").agg(F.sum("w").alias("w")).collect()}  # one row per class
    if not sums:
        raise ValueError(f"no row has a {label}")
    labels, width = sorted(sums), rows.select(F.size("x")).first()[0]
    shares = np.array([sums[x] for x in labels])
    start = np.log(shares / shares.sum())
    edges = _edges(rows, width, params.bins)
    number = {x: i for i, x in enumerate(labels)}

    def bin_rows(batches):
        for b in batches:
            binned = _to_bins(_matrix(b.column("x"), width), edges)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number[x] for x in b.column("label").to_pylist()], pa.int32()),
                    b.column("w"),
                    pa.array([x.tobytes() for x in binned], pa.binary()),
                    pa.array([start.tolist()] * len(binned), pa.list_(pa.float64())),
                ],
                names=["y", "w", "bins", "margins"],
            )

    binned = materialise(rows.mapInArrow(bin_rows, "y int, w double, bins binary, margins array<double>"), "boost-bins")
    trees, gain, since = Trees(len(labels), params.depth), np.zeros(width), 0
    for r in range(params.rounds):
        trees.add()
        if r - since == REFRESH:
            binned, since = materialise(_refreshed(binned, trees, width, since, r), "boost-bins"), r
        if not _grow(binned, trees, gain, width, since, params):
            break  # no tree of this round has a split: none of a later one would
    return BoostedModel(labels, edges, start, trees, gain, params)


def _read(b: pa.RecordBatch, width: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, width)
    return bins, _matrix(b.column("margins"), classes)


def _refreshed(binned: DataFrame, trees: Trees, width: int, since: int, upto: int) -> DataFrame:
    shared = binned.sparkSession.sparkContext.broadcast(trees.state())

    def add(batches):
        known = Trees.of(shared.value)
        for b in batches:
            bins, margins = _read(b, width, known.feature.shape[1])
            now = known.margins(bins, margins, since, upto)
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), b.column("w"), b.column("bins"), pa.array(now.tolist(), pa.list_(pa.float64()))], names=["y", "w", "bins", "margins"]
            )

    return binned.mapInArrow(add, binned.schema)


def _grow(binned: DataFrame, trees: Trees, gain: np.ndarray, width: int, since: int, params: BoostParams) -> bool:
    """Grows the trees of the last round, one pass per level; whether any has a split."""
    last, classes = len(trees.feature) - 1, trees.feature.shape[1]
    context = binned.sparkSession.sparkContext
    for level in range(params.depth):
        first, many = 2**level - 1, 2**level
        size = many * width * params.bins
        shared = context.broadcast(trees.state())

        def add(batches, level=level, first=first, many=many, size=size, shared=shared):
            now, sums = Trees.of(shared.value), np.zeros((2, classes, size), dtype=np.int64)
            for b in batches:
                bins, margins = _read(b, width, classes)
                p = softmax(now.margins(bins, margins, since, last))
                y, w = b.column("y").to_numpy(), b.column("w").to_numpy()
                cell = bins + np.arange(width) * params.bins
                for k in range(classes):
                    at = now.nodes(bins, last, k) - first
                    live = (at >= 0) & (at < many)
                    where = (at[live, None] * (width * params.bins) + cell[live]).ravel()
                    for i, x in enumerate(((p[:, k] - (y == k)) * w, p[:, k] * (1 - p[:, k]) * w)):
                        whole = np.repeat(np.rint(x[live] / _UNIT), width)  # sums of a batch stay below 2**53: exact
                        sums[i, k] += np.bincount(where, whole, size).astype(np.int64)
            shaped = sums.reshape(2, classes * many * width, params.bins)
            row = np.flatnonzero(shaped[1].any(axis=1))
            flat = np.concatenate([shaped[0, row], shaped[1, row]], axis=1)
            offsets = np.arange(len(row) + 1, dtype=np.int32) * (2 * params.bins)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))], names=["row", "sums"]
            )

        added = binned.mapInArrow(add, "row long, sums array<long>").groupBy("row")
        summed = added.agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(2 * params.bins)]).alias("sums")).collect()  # classes x nodes x features
        total = np.zeros((classes * many * width, 2 * params.bins))
        for r in summed:
            total[r["row"]] = r["sums"]
        total = (total * _UNIT).reshape(classes, many, width, 2, params.bins)
        shared.unpersist()
        split = False
        for k in range(classes):
            for n in range(many):
                g, h = total[k, n, :, 0], total[k, n, :, 1]
                if not h[0].any():
                    continue
                won, f, cut = _best_splits(g, h, params) if params.bins > 1 else (-1.0, 0, 0)
                if won <= 1e-9:
                    continue
                node, split = first + n, True
                trees.feature[last, k, node], trees.cut[last, k, node] = f, cut
                gain[f] += won
                for child, part in ((2 * node + 1, slice(0, cut + 1)), (2 * node + 2, slice(cut + 1, None))):
                    trees.value[last, k, child] = -params.rate * g[f, part].sum() / (h[f, part].sum() + params.penalty)
        if not split:
            return level > 0
    return True

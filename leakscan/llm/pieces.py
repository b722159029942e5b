"""Piece probabilities of one or more classes of text, learnt from word counts over a fixed public vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.lattice import Lattice

#: Added to every expected piece count, so that no piece and hence no text is impossible.
SMOOTHING = 0.1
#: Words that one step of a task works on.
BLOCK = 50_000


def rank_weights(size: int) -> np.ndarray:
    """Log probabilities from the vocabulary's own order: its scores fall with the rank, as do frequencies (Zipf)."""
    share = 1.0 / (np.arange(size) + 10.0)
    return np.log(share / share.sum())


def learn(words: DataFrame, lattice: Lattice, classes: list, rounds: int) -> np.ndarray:
    """Log probabilities, pieces x classes, by rounds of expectation and maximisation.

    ``words``: class (index into ``classes``), word (binary), n (long). Each task sums the expected counts of its words, Spark
    sums those of the tasks; what reaches the driver is one number per piece and class.
    """
    spark = words.sparkSession
    weights = np.tile(rank_weights(lattice.size)[:, None], (1, len(classes)))
    shared = spark.sparkContext.broadcast(lattice.state())
    schema = pa.schema([("class", pa.int32()), ("piece", pa.int32()), ("mass", pa.float64())])
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def expect(batches, now=now):
            trie, sums = Lattice.of(shared.value), np.zeros_like(now.value)
            for b in batches:
                kind = b.column("class").to_numpy()
                n = b.column("n").to_numpy(zero_copy_only=False).astype(float)
                word = b.column("word").to_pylist()
                for k in np.unique(kind):
                    at = np.flatnonzero(kind == k)
                    for i in range(0, len(at), BLOCK):
                        part = at[i : i + BLOCK]
                        sums[:, k] += trie.expected([word[x] for x in part], n[part], now.value[:, k])
            piece, kind = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[piece, kind])], schema=schema
            )

        mass = (
            words.select(F.col("class").cast("int").alias("class"), "word", F.col("n").cast("long").alias("n"))
            .mapInArrow(expect, "class int, piece int, mass double")
            .groupBy("class", "piece")
            .agg(F.sum("mass").alias("mass"))
            .toPandas()
        )
        sums = np.full_like(weights, SMOOTHING)
        sums[mass["piece"].to_numpy(), mass["class"].to_numpy()] += mass["mass"].to_numpy()
        weights = np.log(sums / sums.sum(axis=0))
        now.unpersist()
    return weights

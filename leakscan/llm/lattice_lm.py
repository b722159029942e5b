"""Subword lattice likelihood: the probability of a text summed over all segmentations into vocabulary entries.

Entries are the words of the training texts, weighted by their discounted counts, and the pieces of a fixed public vocabulary,
weighted by expected counts over all segmentations of the training words (forward-backward). A word is cut into one whole
entry or into any run of pieces; the pieces share the mass that the discount frees. The forward recursion sums these in log
space, and a text is its words and one end. The result is a proper distribution over word sequences.

Plan: one scan counts words (each task sends its distinct words), one row per distinct word gets its log probability,
so no word is segmented twice. A second scan looks up frequent words, whose number is bounded, in a broadcast table; other
words go through a shuffle join on the word. Nothing of a text is collected.

Cases: null or empty text: the end alone. Null id: training text (its remainder is not the held-out one). Repeated rows
and ids: each row is counted and scored by itself. No training rows: counts are 0, every word is spelt by the vocabulary's own order.
Words longer than a task's block are segmented like others. Only the id and text columns are read; others cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.common import batch, fold, table, text_bytes
from leakscan.llm.lattice import Lattice, public_pieces
from leakscan.llm.pieces import BLOCK, learn
from leakscan.session import materialise

#: Words with the highest counts that travel to every task; all others are joined.
HEAD_WORDS = 200_000
#: Distinct words a counting task holds before it sends them on.
FLUSH = 400_000
ROUNDS = 3


@dataclass
class LatticeModel:
    """words: word, n (training count), lp (log10 probability), for every word of training and scored texts."""

    words: DataFrame
    tokens: int
    distinct: int
    ends: int
    end_score: float
    head: dict

    @property
    def mass(self) -> int:
        """What the add-one counts of the base sum to."""
        return self.tokens + self.distinct + 1


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def count_words(docs: DataFrame, text: str, training) -> DataFrame:
    """word, n: occurrences in training rows (0 for words of other rows only)."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for raw, train in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(raw)
                seen.update(words if train else dict.fromkeys(words, 0))
                if len(seen) > FLUSH:
                    yield batch(schema, list(seen), list(seen.values()))
                    seen.clear()
        if seen:
            yield batch(schema, list(seen), list(seen.values()))

    rows = docs.select(text_bytes(text).alias("text"), training.alias("train"))
    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: str, text: str = "text", training=None, rounds: int = ROUNDS) -> LatticeModel:
    """Learns from the rows where ``training`` holds (all by default); ``vocabulary``: file of public pieces."""
    spark = docs.sparkSession
    training = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    counted = materialise(count_words(docs, text, training), "lm-counts")
    sums = counted.agg(
        *(F.coalesce(c.cast("long"), F.lit(0)).alias(name) for name, c in (
            ("tokens", F.sum("n")),
            ("distinct", F.sum(F.when(F.col("n") > 0, 1))),
            ("once", F.sum(F.when(F.col("n") == 1, 1))),
            ("twice", F.sum(F.when(F.col("n") == 2, 1))),
        ))
    ).first()
    ends = docs.filter(training).count()
    total, distinct = sums["tokens"] + ends, sums["distinct"] + (ends > 0)
    discount = sums["once"] / (sums["once"] + 2 * sums["twice"]) if sums["once"] else 0.5
    discount = min(max(discount, 0.1), 0.9)
    lattice = Lattice(public_pieces(vocabulary))
    types = counted.filter("n > 0").select(F.lit(0).alias("class"), "word", F.lit(1).alias("n"))
    weights = learn(types, lattice, ["all"], rounds)[:, 0]
    freed = math.log(discount * distinct / total) if total else 0.0
    shared = spark.sparkContext.broadcast((lattice.state(), weights))
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("lp", pa.float64())])

    def judge(batches):
        trie, weights = Lattice.of(shared.value[0]), shared.value[1]
        for b in batches:
            word, n = b.column("word").to_pylist(), b.column("n").to_numpy().astype(float)
            for i in range(0, len(word), BLOCK):
                part, count = word[i : i + BLOCK], n[i : i + BLOCK]
                spelt = freed + trie.log_probability(part, weights)
                with np.errstate(divide="ignore"):
                    whole = np.log(np.maximum(count - discount, 0) / max(total, 1))
                yield batch(schema, part, count.astype(np.int64), np.logaddexp(whole, spelt) / math.log(10))

    words = materialise(counted.mapInArrow(judge, "word binary, n long, lp double"), "lm-words")
    end = math.log10(max(ends - discount, discount) / total) if total else 0.0
    return LatticeModel(words, total, distinct, ends, end, _head(words))


def _head(words: DataFrame) -> dict:
    """The most frequent words with count and score: all words from the lowest power of two on that keeps the bound."""
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = words.filter("n > 0").groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()  # at most 63
    room, lowest = HEAD_WORDS, None
    for row in sizes:
        room -= row["count"]
        if room < 0:
            break
        lowest = row["power"]
    if lowest is None:
        return {}
    top = words.filter(F.col("n") >= 2**lowest).toArrow()
    return dict(
        zip(top["word"].to_pylist(), zip(top["n"].to_pylist(), top["lp"].to_pylist(), strict=True), strict=True)
    )


def score(docs: DataFrame, model: LatticeModel, keep: list[str], text: str = "text") -> DataFrame:
    """Per row: the columns ``keep``, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    kept = {name: f"k{i}" for i, name in enumerate(keep)}
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.struct(*(F.col(f"`{name}`").alias(k) for name, k in kept.items())).alias("kept"),
        text_bytes(text).alias("text"),
    )
    ends, end_score, mass = model.ends, model.end_score, model.mass
    head = spark.sparkContext.broadcast(model.head)
    total = model.tokens

    def scan(batches):
        names = ["uid", "kept", "word", "times", "n_tokens", "n_known", "base_score", "score"]
        known = head.value
        for b in batches:
            uid, kind = b.column("uid").to_pylist(), b.column("kept").type
            whole = {name: [] for name in names}
            rest: tuple[list, list, list] = ([], [], [])
            for u, raw in zip(uid, b.column("text").to_pylist(), strict=True):
                words = tokens(raw)
                sums = [len(words) + 1, int(ends > 0), math.log10((ends + 1) / mass), end_score]
                for w, times in Counter(words).items():
                    if w in known:
                        n, lp = known[w]
                        sums[1] += times
                        sums[2] += times * math.log10((n + 1) / mass)
                        sums[3] += times * lp
                    else:
                        rest[0].append(u)
                        rest[1].append(w)
                        rest[2].append(times)
                for name, value in zip(names[4:], sums, strict=True):
                    whole[name].append(value)
            count, more = len(uid), len(rest[0])
            own = [b" %d" % u for u in uid]  # a space: no word is equal, and no two rows share a key
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + rest[0], pa.int64()),
                    pa.concat_arrays([b.column("kept"), pa.nulls(more, kind)]) if more else b.column("kept"),
                    pa.array(own + rest[1], pa.binary()),
                    pa.array([0] * count + rest[2], pa.int64()),
                    *(pa.array(whole[n] + [0] * more, pa.int64()) for n in names[4:6]),
                    *(pa.array(whole[n] + [0.0] * more, pa.float64()) for n in names[6:]),
                ],
                names=names,
            )

    kind = rows.schema["kept"].dataType.simpleString()
    parts = rows.mapInArrow(
        scan,
        f"uid long, kept {kind}, word binary, times long, n_tokens long, n_known long, base_score double, score double",
    )
    per_word = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 1) / F.lit(float(mass)))
    times, found = F.col("times"), F.col("times") > 0
    joined = parts.join(model.words, "word", "left").select(
        "uid",
        "kept",
        "n_tokens",
        (F.col("n_known") + F.when(found & (F.col("n") > 0), times).otherwise(0)).alias("n_known"),
        (F.col("base_score") + F.when(found, times * per_word).otherwise(0)).alias("base_score"),
        (F.col("score") + F.when(found, times * F.col("lp")).otherwise(0)).alias("score"),
    )
    return (
        joined.groupBy("uid")
        .agg(
            F.first("kept", ignorenulls=True).alias("kept"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.sum("base_score").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .select(
            *(F.col(f"kept.{k}").alias(name) for name, k in kept.items()),
            "n_tokens",
            "n_known",
            F.lit(total).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )
    )


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out")
    )
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"), training=~F.col("held_out"))
    return score(docs, model, ["doc_id", "held_out"])

"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary, learnt as expected counts over all segmentations
of its training words. A text's likelihood under a language is the sum over all segmentations of the product of its pieces'
probabilities (forward algorithm, in log space), which factorises over words. The prediction is the language with the highest
posterior under the training shares of languages.

Plan: training takes a bounded number of labelled rows per language (``ROWS_PER_LANGUAGE``, drawn by a hash of the id, so
independent of partitioning); Spark counts their words by language and each learning round is one distributed pass over the
counts. Prediction is map-only: a task segments each distinct word of a batch once and adds up the words of its texts.

Cases: null text or one without a letter: ``und``, score 0. Null labels are not learnt from. Null id: learnt from like others.
Ties: the first language in order. Nothing to learn from: every text is ``und``. Texts are never cut.
Repeated rows: each is predicted by itself. Columns beside id, text and label are never read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.common import batch, fold, released, spans, table, text_bytes
from leakscan.llm.lattice import Lattice, public_pieces
from leakscan.llm.pieces import BLOCK, learn

#: Bound on the labelled rows that each language is learnt from.
ROWS_PER_LANGUAGE = 2_000
ROUNDS = 3
#: Bytes of text whose distinct words are segmented at a time; bounds the table of word scores.
BLOCK_BYTES = 3_000_000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    languages: list[str]
    lattice: Lattice
    weights: np.ndarray
    prior: np.ndarray


def fit(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    rounds: int = ROUNDS,
) -> LanguageModel:
    """Learns from the labelled rows of ``docs``; at most about ``rows_per_language`` rows of each language."""
    labelled = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("string").alias("label")
    ).filter("label is not null and text is not null")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # one row per language
    languages = sorted(sizes)
    lattice = Lattice(public_pieces(vocabulary))
    if not languages:
        return LanguageModel([], lattice, np.zeros((lattice.size, 0)), np.zeros(0))
    share = F.create_map(*(F.lit(v) for k in languages for v in (k, min(1.0, rows_per_language / sizes[k]))))
    code = F.create_map(*(F.lit(v) for i, k in enumerate(languages) for v in (k, i)))
    draw = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(draw < share[F.col("label")]).select(
        code[F.col("label")].alias("class"), text_bytes().alias("text")
    )
    schema = pa.schema([("class", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        for b in batches:
            seen: dict[int, Counter] = {}
            for kind, raw in zip(b.column("class").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.setdefault(kind, Counter()).update(raw.lower().split())
            for kind, words in seen.items():
                yield batch(schema, [kind] * len(words), list(words), list(words.values()))

    words = (
        sample.mapInArrow(count, "class int, word binary, n long").groupBy("class", "word").agg(F.sum("n").alias("n"))
    ).persist()
    try:
        weights = learn(words, lattice, languages, rounds)
    finally:
        words.unpersist()
    prior = np.array([sizes[k] for k in languages], dtype=float)
    return LanguageModel(languages, lattice, weights, np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """Per row: the columns ``keep``, lang_pred, score (posterior of the prediction, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.lattice.state(), model.weights, model.prior))
    columns = [*keep, *([text] if text not in keep else [])]  # a text travels once, whether it is kept or not
    kept = {name: f"k{i}" for i, name in enumerate(columns)}
    rows = docs.select(F.struct(*(F.col(f"`{name}`").alias(k) for name, k in kept.items())).alias("kept"))
    at = columns.index(text)

    def tell(batches):
        languages, state, weights, prior = shared.value
        known = LanguageModel(languages, Lattice.of(state), weights, prior)
        for b in batches:
            whole = b.column("kept").field(at).cast(pa.binary())
            for i, j in spans(pc.binary_length(whole).fill_null(0).to_numpy(zero_copy_only=False), BLOCK_BYTES):
                names, scores = [], []
                for row in _posteriors([t or b"" for t in whole.slice(i, j - i).to_pylist()], known):
                    best = int(row.argmax()) if row is not None else None
                    names.append(UNDETERMINED if best is None else known.languages[best])
                    scores.append(0.0 if best is None else float(row[best]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("kept").slice(i, j - i), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["kept", "lang_pred", "score"],
                )

    kind = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(released(tell), f"kept {kind}, lang_pred string, score double").select(
        *(F.col(f"kept.{kept[name]}").alias(name) for name in keep), "lang_pred", "score"
    )


def _posteriors(texts: list[bytes], known: LanguageModel):
    number: dict[bytes, int] = {}
    counted = []  # numbers of a text's distinct words and how often each occurs; a word is held once for all texts
    for t in texts:
        if not _LETTER.search(t.decode("utf-8", "replace")):
            counted.append(None)
            continue
        words = Counter(t.lower().split())
        at = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words))
        counted.append((at, np.fromiter(words.values(), dtype=np.int32, count=len(words))))
    if not known.languages:
        return [None] * len(texts)
    words = list(number)
    table_ = np.empty((len(words), len(known.languages)))
    for i in range(0, len(words), BLOCK):
        table_[i : i + BLOCK] = known.lattice.log_probability(words[i : i + BLOCK], known.weights)
    out = []
    for text in counted:
        if text is None:
            out.append(None)
            continue
        at, times = text
        log = known.prior + times.astype(float) @ table_[at]
        log = np.exp(log - log.max())
        out.append(log / log.sum())
    return out


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (fold("doc_id", 5) == 0).alias("held_out")
    )
    model = fit(docs.filter("not held_out"), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model, ["doc_id", "held_out"])

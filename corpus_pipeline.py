"""A corpus pipeline of four operators: quality rules, language identification, near-duplicates, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result
to the shared folder and reads it again, so a stage works on all that its predecessor kept and a lost executor costs no
earlier stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm import language, order_minhash, packing, quality
from leakscan.session import materialise

#: Texts whose language has a lower posterior are rejected.
LEAST_POSTERIOR = 0.5
#: Bytes of text that packing encodes at a time, and of its table of words: less than by itself, as the JVM keeps the heap that
#: earlier stages grew.
PACKED_BLOCK, PACKED_TABLE = 2_000_000, 60_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule and whose host does not fail."""
    judged = quality.judge(docs, docs.columns)
    return judged.filter("kept").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learnt from the labels of the documents themselves."""
    import public_tokenizers

    model = language.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    told = language.predict(docs, model, docs.columns)
    kept = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_POSTERIOR)
    return told.filter(kept).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.deduplicate(docs, "doc_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, ["doc_id"], path, block=PACKED_BLOCK, table_bytes=PACKED_TABLE, trim=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Language models, samples of hashes and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

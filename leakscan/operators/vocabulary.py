"""Vocabulary, inverse document frequencies and TF-IDF weights."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions.text import join_words, ngrams, normalise, split_words, tokens


def read_words(text_col: str) -> Column:
    """The words of a text as one string, to be kept where several passes need them; ``joined`` says below that a column holds it."""
    return join_words(tokens(normalise(F.col(text_col))))


def _words(text_col: str, joined: bool) -> Column:
    return split_words(F.col(text_col)) if joined else tokens(normalise(F.col(text_col)))


def with_terms(
    df: DataFrame, text_col: str, low: int = 1, high: int = 2, into: str = "terms", joined: bool = False
) -> DataFrame:
    """Adds the n-grams of a text column."""
    held = f"_{into}_words"
    return df.withColumn(held, _words(text_col, joined)).withColumn(into, ngrams(F.col(held), low, high)).drop(held)


# Above this many frequent words the pruning of fit_vocabulary gives way to plain counting.
MAX_FREQUENT_WORDS = 20_000


def _count_terms(df: DataFrame, terms: str) -> DataFrame:
    """``(term, df, tf)`` over a column of term arrays.

    Each document gives its terms once as they are and once without repeats, in one scan. One exchange on the term,
    after partial aggregation, then yields both counts: no (term, document) pair is shuffled.
    """
    lists = F.array(
        F.struct(F.lit(0).alias("once"), F.col(terms).alias("terms")),
        F.struct(F.lit(1).alias("once"), F.array_distinct(terms).alias("terms")),
    )
    exploded = df.select(F.explode(lists).alias("l")).select(F.col("l.once"), F.explode("l.terms").alias("term"))
    return exploded.groupBy("term").agg(F.sum("once").alias("df"), F.sum(1 - F.col("once")).alias("tf"))


def term_counts(df: DataFrame, text_col: str, low: int = 1, high: int = 2, joined: bool = False) -> DataFrame:
    """``(term, df, tf)``: number of documents holding the term and its total count."""
    return _count_terms(with_terms(df, text_col, low, high, joined=joined).select("terms"), "terms")


def fit_vocabulary(
    df: DataFrame,
    text_col: str,
    max_terms: int = 100,
    min_df: int = 2,
    low: int = 1,
    high: int = 2,
    max_frequent: int = MAX_FREQUENT_WORDS,
    joined: bool = False,
) -> DataFrame:
    """The ``max_terms`` most frequent terms found in at least ``min_df`` documents; ties go to the smaller term.

    With single words in the vocabulary, longer terms are pruned before they are counted: a term is never more frequent
    than any word in it, so one that makes the cut consists of words that reach the count of the last word within it.
    Only such terms are shuffled. The result is the same as counting all of them.
    """
    columns = ("term", "df", "tf")
    if low > 1 or high == 1:
        return _top(term_counts(df, text_col, low, high, joined).filter(F.col("df") >= min_df), max_terms)

    words = term_counts(df, text_col, 1, 1, joined).filter(F.col("df") >= min_df)
    # One row more than the cut, so that ties with its last word show.
    top = words.orderBy(F.desc("tf"), "term").limit(max(max_terms, max_frequent) + 1).collect()
    least = top[max_terms - 1]["tf"] if len(top) >= max_terms else 0
    frequent = [r for r in top if r["tf"] >= least]
    if len(frequent) > max_frequent:
        return _top(term_counts(df, text_col, low, high, joined).filter(F.col("df") >= min_df), max_terms)
    if not frequent:
        return words
    spark = df.sparkSession
    singles = spark.createDataFrame([(r["term"], r["df"], r["tf"]) for r in frequent[:max_terms]], "term string, df long, tf long")
    known = [r["term"] for r in frequent]
    kept = df.select(_words(text_col, joined).alias("words")).select(
        F.transform("words", lambda w: F.when(w.isin(known), w)).alias("words")
    )
    # A term with a word that was blanked out is null and drops out.
    longer = kept.select(F.array_compact(ngrams(F.col("words"), 2, high)).alias("terms"))
    counted = _count_terms(longer, "terms").filter(F.col("df") >= min_df)
    return _top(singles.select(*columns).unionByName(counted.select(*columns)), max_terms)


def _top(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("tf"), "term").limit(n)


def idf(document_frequency: Column, documents: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((documents + 1) / (document_frequency + 1)) + 1


def fit_idf(
    df: DataFrame, text_col: str, max_terms: int = 100, min_df: int = 2, low: int = 1, high: int = 2, joined: bool = False
) -> DataFrame:
    """``(term, df, tf, idf)`` of the vocabulary. The document count is a scalar subquery over an empty projection."""
    documents = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    terms = fit_vocabulary(df, text_col, max_terms, min_df, low, high, joined=joined)
    return terms.withColumn("idf", idf(F.col("df"), documents))


class TfIdf:
    """TF-IDF over a fixed vocabulary: sparse, L2-normalised, terms in alphabetical order."""

    def __init__(self, terms: list[str], weights: list[float], low: int = 1, high: int = 2):
        ordered = sorted(zip(terms, weights), key=lambda p: p[0].encode("utf-8"))
        self.terms = [t for t, _ in ordered]
        self.weights = [float(w) for _, w in ordered]
        self.low, self.high = low, high

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        text_col: str,
        max_terms: int = 100,
        min_df: int = 2,
        low: int = 1,
        high: int = 2,
        joined: bool = False,
    ) -> TfIdf:
        """Only the vocabulary, at most ``max_terms`` rows, reaches the driver."""
        rows = fit_idf(df, text_col, max_terms, min_df, low, high, joined).collect()
        if not rows:
            raise ValueError(f"no term occurs in {min_df} documents or more")
        return cls([r.term for r in rows], [r.idf for r in rows], low, high)

    def transform(self, df: DataFrame, text_col: str, into: str = "tfidf", joined: bool = False) -> DataFrame:
        counted, scaled, terms = f"_{into}_tf", f"_{into}_raw", f"_{into}_terms"
        vectorizer = CountVectorizerModel.from_vocabulary(self.terms, inputCol=terms, outputCol=counted)
        scaler = ElementwiseProduct(scalingVec=Vectors.dense(self.weights), inputCol=counted, outputCol=scaled)
        normalizer = Normalizer(p=2.0, inputCol=scaled, outputCol=into)
        out = with_terms(df, text_col, self.low, self.high, terms, joined)
        for stage in (vectorizer, scaler, normalizer):
            out = stage.transform(out)
        return out.drop(terms, counted, scaled)

    def long(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``(id, term, weight)`` of the non-zero weights; read off the vector, so nothing is shuffled.

        The outer form of explode keeps Catalyst from adding a filter on the vector, which would compute it again.
        """
        names = F.array(*[F.lit(t) for t in self.terms])
        sparse = F.unwrap_udt("tfidf")
        held = F.arrays_zip(sparse["indices"].alias("pos"), sparse["values"].alias("weight"))
        weights = self.transform(df, text_col).select(id_col, F.explode_outer(held).alias("w"))
        return weights.filter(F.col("w.weight") > 0).select(
            id_col, F.get(names, F.col("w.pos")).alias("term"), F.col("w.weight").alias("weight")
        )

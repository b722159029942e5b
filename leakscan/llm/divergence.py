"""Which sources of a language use its words differently: a divergence audit from token-start pointer sorts.

A task takes the texts of a block as they lie in Arrow's buffers, sorted by (language, source), points at the starts of their
words and sorts the pointers by multikey quicksort (``word_sort``). A run of equal words then yields, for each source, its
occurrences and the documents that hold it, without a string being made for more than the first of the run. Spark adds the
runs of all blocks up.

A language's kept terms are those in at least ``LEAST`` of its documents. Each source, and the language as a whole, gives each
kept term a smoothed share p in parts of 10**9; how far two shares lie apart is (p - q)**2 / (p + q), rounded down.
``pair`` sums this over all kept terms for each two sources of a language, ``term`` names the terms that a source uses more
than its language does. All arithmetic is on integers or decimals.

Plan: one scan; the exchange carries one row per (language, source, term) and task. The counts are written to the shared
folder, since vocabulary, totals and both parts read them. Pairs: kept terms are dealt into blocks of ``TERMS`` by hash and
sources into tiles of ``TILE``; a task holds a block of terms for two tiles as a matrix and adds up all pairs of its
sources, terms that occur nowhere in it being counted in closed form. So no language, source or term is held by one task,
and no pair is made per term. Rows out: the square of a language's sources, as the result has to be.

Cases: null text, language or source: ''. A group without terms, and a language without kept terms, is there with value 0 in
``pair`` and without rows in ``term``. Repeated rows are documents of their own. Very long words count like others. Ties: by
the bytes of the item. Empty table: no rows. Only text, language and source are read, so further columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscan.llm.common import spans, table, text_bytes
from leakscan.llm.word_sort import PointerSort, word_starts
from leakscan.operators.lookup import bounded_lookup
from leakscan.session import materialise

#: Documents of a language that a kept term is in at least; ranks of terms that are reported.
LEAST, TOP = 10, 10
SHARES = 1_000_000_000
#: Bytes of text whose words are sorted at a time.
BLOCK = 12_000_000
#: Terms and sources that one task compares at a time.
TERMS, TILE = 2048, 256
_COUNTS = "lang string, source string, term binary, docs long, n long"


def _runs(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, documents, occurrences) of the texts of a binary array; ``group`` must not fall."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[low:high]
    offsets = offsets - low
    folded, starts, lengths = word_starts(data, offsets)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return pa.array([], pa.binary()), none, none, none
    doc = np.searchsorted(offsets, starts, side="right") - 1
    sort = PointerSort(folded, starts, lengths)
    doc = doc[sort.order]
    of = group[doc]
    segment, fresh = sort.new.copy(), sort.new.copy()
    segment[1:] |= of[1:] != of[:-1]
    fresh[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(segment)
    first = sort.order[at]
    size = lengths[first]
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = folded[np.arange(ends[-1]) + np.repeat(starts[first] - ends[:-1], size)]
    terms = pa.BinaryArray.from_buffers(
        pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]
    )
    return terms, of[at], np.add.reduceat(fresh.astype(np.int64), at), np.diff(np.append(at, len(segment)))


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, docs, n); the empty term stands for the group itself, ``docs`` being its documents."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"), text_bytes(text).alias("text"))

    def count(batches):
        for b in batches:
            langs, sources = (pc.dictionary_encode(b.column(c)) for c in ("lang", "source"))
            code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            groups, group = np.unique(code, return_inverse=True)
            by = np.argsort(group, kind="stable")
            texts, group = b.column("text").take(pa.array(by)), group[by]
            heads = [langs.dictionary.take(pa.array(groups // len(sources.dictionary))), sources.dictionary.take(pa.array(groups % len(sources.dictionary)))]
            size = np.bincount(group, minlength=len(groups))
            yield pa.RecordBatch.from_arrays(
                [*heads, pa.array([b""] * len(groups), pa.binary()), pa.array(size), pa.array(np.zeros_like(size))],
                names=["lang", "source", "term", "docs", "n"],
            )
            for i, j in spans(pc.binary_length(texts).to_numpy(), BLOCK):
                terms, of, held, n = _runs(texts.slice(i, j - i), group[i:j])
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [heads[0].take(at), heads[1].take(at), terms, pa.array(held), pa.array(n)],
                    names=["lang", "source", "term", "docs", "n"],
                )

    return (
        rows.mapInArrow(count, _COUNTS)
        .groupBy("lang", "source", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        .withColumn("term", F.col("term").cast("string"))
    )


def _share(n: str, total: str, terms: str) -> F.Column:
    """1 + floor(SHARES * (n + 2) / (total + 2 * terms)); null without terms."""
    big = lambda x: f"cast({x} as decimal(20, 0))"
    return F.expr(f"if({terms} > 0, 1 + ({big(f'{n} + 2')} * {SHARES}) div {big(f'{total} + 2 * {terms}')}, null)")


def kept_terms(counted: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, lang_n of the kept terms; lang, source, sid, total, lang_total, terms of every group)."""
    terms = counted.filter("term != ''")
    vocabulary = (
        terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least)
    ).drop("docs")
    kept = materialise(terms.drop("docs").join(vocabulary, ["lang", "term"]), "divergence-kept")
    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # a term's total stands with each of its sources; count it with one of them
    per_term = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    per_lang = per_term.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    groups = counted.filter("term = ''").select("lang", "source").join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
    numbered = Window.partitionBy("lang").orderBy("source")  # the sources of a language, whose square the result holds
    return kept, materialise(
        groups.fillna(0, ["total", "lang_total", "terms"]).withColumn("sid", F.row_number().over(numbered) - 1), "divergence-groups"
    )


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the terms that a source uses more than its language."""
    held = bounded_lookup(groups.drop("sid"))
    shares = kept.join(held, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q")
    )
    valued = shares.filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _unit(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of a block for all pairs of a source of one tile and one of the other (or the same)."""
    heads, cells = rows[rows["term"].isna()], rows[rows["term"].notna()]
    heads = heads.sort_values("sid")
    sid, names, none = heads["sid"].to_numpy(), heads["source"].to_numpy(), heads["p"].fillna(0).to_numpy().astype(np.int64)
    number, terms = pd.factorize(cells["term"])
    shares = np.tile(none, (len(terms), 1))
    shares[number, np.searchsorted(sid, cells["sid"].to_numpy())] = cells["p"].to_numpy().astype(np.int64)
    first = rows.iloc[0]
    left, right = np.flatnonzero(sid // TILE == first["low"]), np.flatnonzero(sid // TILE == first["high"])
    absent = (int(first["terms"]) if first["block"] == 0 else 0) - len(terms)  # terms of no source here, in closed form
    out = []
    for i in left:
        other = right[right > i]
        if not len(other):
            continue
        gap, both = shares[:, other] - shares[:, i : i + 1], shares[:, other] + shares[:, i : i + 1]
        value = (gap * gap // both).sum(axis=0) if len(terms) else np.zeros(len(other), np.int64)
        if first["terms"]:
            value = value + absent * ((none[other] - none[i]) ** 2 // (none[other] + none[i]))
        out.append((np.repeat(i, len(other)), other, value))
    a, b, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else np.zeros((3, 0), dtype=np.int64)
    names = names.astype(object)
    lang = np.full(len(a), first["lang"], dtype=object)
    return pd.DataFrame({"lang": lang, "source": names[a], "item": names[b], "value": value}, dtype=object).astype({"value": np.int64})


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source), value, rank for every two sources of a language."""
    held = groups.withColumns(
        {
            "blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int"),
            "tiles": (F.floor((F.max("sid").over(Window.partitionBy("lang"))) / TILE) + 1).cast("int"),
            "tile": F.floor(F.col("sid") / TILE).cast("int"),
        }
    )
    facts = bounded_lookup(held)
    cells = kept.join(facts, ["lang", "source"]).select(
        "lang", "source", "sid", "terms", "tiles", "tile", "term", _share("n", "total", "terms").alias("p"),
        F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"),
    )
    heads = held.select(
        "lang", "source", "sid", "terms", "tiles", "tile", F.lit(None).cast("string").alias("term"),
        _share("0", "total", "terms").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    units = cells.unionByName(heads).select("*", other).select(
        "lang", "source", "sid", "terms", "term", "p", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")
    )
    half = units.groupBy("lang", "block", "low", "high").applyInPandas(_unit, "lang string, source string, item string, value long")
    summed = half.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p")
    pairs = summed.select("lang", "value", both).select("lang", "p.source", "p.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    counted = materialise(counts(docs, text, lang, source), "divergence-counts")
    kept, groups = kept_terms(counted, least)
    parts = [source_pairs(kept, groups).withColumn("part", F.lit("pair")), top_terms(kept, groups, top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
spread AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM spread GROUP BY lang, source, term),
vocabulary AS (SELECT lang, term, sum(n) AS lang_n FROM counted GROUP BY lang, term HAVING sum(docs) >= 10),
langs AS (SELECT lang, sum(lang_n) AS lang_total, count(*) AS v FROM vocabulary GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
kept AS (SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n, t.lang_n
  FROM sources s JOIN vocabulary t ON s.lang = t.lang
  LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term),
totals AS (SELECT lang, source, sum(n) AS total FROM kept GROUP BY lang, source),
shares AS (SELECT k.lang, k.source, k.term, k.n,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (t.total + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.lang_total + 2 * l.v) AS q
  FROM kept k JOIN totals t ON k.lang = t.lang AND k.source = t.source JOIN langs l ON k.lang = l.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

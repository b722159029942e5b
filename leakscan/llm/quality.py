"""Host-level quality rules: rule failures of documents, aggregated by host, shrunk by an empirical beta prior.

Document rules: fewer than ``MIN_WORDS`` words, or more than half of the words in 3-word windows that occur twice or more
in the text. Host rule: the failure rates of all hosts give a beta prior by the method of moments (weighted by documents); a
host's rate is the posterior mean under it, so a host with few documents is judged mostly by the others. A host whose
shrunk rate exceeds ``MAX_RATE`` is rejected with all its documents.

Plan: one map-only pass computes the counts of each text; the join and the aggregation see narrow rows. Host counts are
partially aggregated, one row per host and task, and the verdict goes back by an equi-join on the host that AQE may
broadcast or split where one host holds a large share.

Cases: null text: no words, fails. Null host: one host of its own, named null. Repeated rows count as often as they occur.
Empty table: empty result. One host: no variance, its own rate. No column is needed beside id, host and text.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.common import table, text_bytes
from leakscan.session import materialise

MIN_WORDS = 50
#: Hosts beyond this shrunk failure rate are rejected.
MAX_RATE = 0.5
#: Pseudo-documents of the prior: at least and at most.
PRIOR = (1.0, 1000.0)
_SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_stats(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = raw.split()
    chars = len(raw.decode("utf-8", "replace")) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = 0  # words up to here are counted
            for i, window in enumerate(windows):
                if seen[window] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def document_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` (as struct ``kept``) and the counts of the text."""
    rows = docs.select(F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep))).alias("kept"), text_bytes(text).alias("text"))

    def measure(batches):
        for b in batches:
            found = list(map(text_stats, b.column("text").to_pylist()))
            columns = zip(*found, strict=True) if found else [()] * len(STATS)
            yield pa.RecordBatch.from_arrays(
                [b.column("kept"), *(pa.array(c, pa.int64()) for c in columns)], names=["kept", *STATS]
            )

    kind = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(measure, ", ".join([f"kept {kind}", *(f"{s} long" for s in STATS)]))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_verdicts(failures: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """host, failed (boolean) per document -> host, host_docs, host_failed, host_rate (shrunk), host_kept."""
    hosts = failures.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")
    )
    # sums over hosts: docs, failures, failures squared by docs, docs squared; enough for mean and variance of the rates
    moments = hosts.agg(
        F.count(F.lit(1)).alias("h"),
        F.sum("host_docs").alias("n"),
        F.sum("host_failed").alias("f"),
        F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_docs")).alias("ff"),
        F.sum(F.col("host_docs") * F.col("host_docs")).alias("nn"),
    )
    mean = F.col("f") / F.col("n")
    # variance of the rates beyond what drawing documents explains (one-way analysis of variance)
    within = (F.col("f") - F.col("ff")) / F.greatest(F.col("n") - F.col("h"), F.lit(1))
    between = (F.col("ff") - F.col("n") * mean * mean) / F.greatest(F.col("h") - 1, F.lit(1))
    size = (F.col("n") - F.col("nn") / F.col("n")) / F.greatest(F.col("h") - 1, F.lit(1))
    variance = F.when(size > 0, F.greatest((between - within) / size, F.lit(0.0))).otherwise(0.0)
    strength = F.when(variance > 0, mean * (1 - mean) / variance - 1).otherwise(PRIOR[1])
    prior = moments.select(
        mean.alias("mean"), F.least(F.greatest(strength, F.lit(PRIOR[0])), F.lit(PRIOR[1])).alias("strength")
    )
    rate = (F.col("host_failed") + F.col("mean") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    return (
        hosts.join(F.broadcast(prior))  # one row
        .withColumn("host_rate", rate)
        .select("host", "host_docs", "host_failed", "host_rate", (F.col("host_rate") <= max_rate).alias("host_kept"))
    )


def judge(docs: DataFrame, keep: list[str], text: str = "text", host: str = "source") -> DataFrame:
    """Per row: the columns ``keep``, the counts, base_failed, kept (false if the document or its host fails)."""
    names = [*keep, host]
    stats = document_stats(docs, names, text).select(
        *(F.col(f"kept.k{i}").alias(f"k{i}") for i in range(len(names))), *STATS, base_failed().alias("base_failed")
    )
    stats = materialise(stats, "quality-stats")
    host_column = F.col(f"k{len(keep)}")
    verdicts = host_verdicts(stats.select(host_column.alias("host"), F.col("base_failed").alias("failed")))
    return stats.join(verdicts, host_column.eqNullSafe(F.col("host")), "left").select(
        *(F.col(f"k{i}").alias(name) for i, name in enumerate(keep)),
        *STATS,
        "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"])


#: The same rules in SQL. The white space of a word is ASCII only, as in the text functions above.
SQL = r"""
with d as (
  select row_number() over () as uid, doc_id, source, coalesce(text, '') as t from documents
),
w as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from d
),
win as (
  select uid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select uid, words, unnest(range(1, len(words) - 1)) as i from w)
),
twice as (
  select uid, i from (select uid, i, count(*) over (partition by uid, g) as c from win) where c > 1
),
rep as (
  select uid, count(distinct p) as n from (select uid, unnest([i, i + 1, i + 2]) as p from twice) group by uid
),
s as (
  select w.uid, doc_id, source, len(words)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(rep.n, 0)::bigint as n_repeat_words
  from w left join rep on w.uid = rep.uid
),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
h as (select source, count(*)::double as n, sum(base_failed::int)::double as f from b group by source),
m as (
  select count(*)::double as h, sum(n) as n, sum(f) as f, sum(f * f / n) as ff, sum(n * n) as nn from h
),
v as (
  select f / n as mean,
    case when (n - nn / n) / greatest(h - 1, 1) > 0 then greatest(
      ((ff - n * (f / n) * (f / n)) / greatest(h - 1, 1) - (f - ff) / greatest(n - h, 1))
      / ((n - nn / n) / greatest(h - 1, 1)), 0) else 0 end as var
  from m
),
p as (
  select mean, least(greatest(case when var > 0 then mean * (1 - mean) / var - 1 else 1000 end, 1), 1000) as k from v
),
verdict as (select h.source, (h.f + p.mean * p.k) / (h.n + p.k) <= 0.5 as host_kept from h, p)
select b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
  not b.base_failed and verdict.host_kept as kept
from b join verdict on b.source is not distinct from verdict.source
"""

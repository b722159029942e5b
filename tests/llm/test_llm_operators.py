"""The operators on Spark: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and the queries."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

from leakscan.llm import chat, digest, extract, language, lattice_lm, order_minhash, packing, prefix_bpe, quality, warc
from leakscan.llm.queries import ORACLES, QUERIES

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
CLASHING = "uid long, kept string, word string, part int, key string, id string, rank int, score double, length int, raw string"
LONG = " ".join(f"word{i % 700}" for i in range(60_000))
PROSE = "the cat sat on the mat and looked at the other cats that were sitting there as well on one of the mats " * 3


@pytest.fixture(scope="module")
def docs(spark):
    near = PROSE.replace("looked", "stared", 1)
    texts = [None, "", " \n\t", "short text", LONG, PROSE, PROSE, near, "1234 5678", "é" * 50, PROSE, "x"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 6, None]
    clash = (7, "k", "w", 1, "k", "i", 3, 0.5, 4, "r")
    rows = [(i, t, "en", "src" if i else None, *clash) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASHING}")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_language_model(docs, empty):
    model = lattice_lm.fit(docs, VOCABULARY, rounds=1)
    rows = lattice_lm.score(docs, model, ["doc_id", "uid", "kept"]).collect()
    assert len(rows) == 12 and {r["uid"] for r in rows} == {7}
    counts = Counter(w for (t,) in docs.select("text").collect() for w in (t or "").lower().split())
    total, distinct = sum(counts.values()) + 12, len(counts) + 1
    for r in rows:
        if r["doc_id"] == 4:
            base = sum(math.log10((n + 1) / (total + distinct + 1)) for n in (counts["short"], counts["text"], 12))
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 3, total) and abs(r["base_score"] - base) < 1e-9
        assert r["score"] < 0 and r["n_tokens"] >= 1
    assert lattice_lm.score(empty, model, ["doc_id"]).count() == 0
    nothing = lattice_lm.fit(empty, VOCABULARY, rounds=1)
    assert lattice_lm.score(docs, nothing, ["doc_id"]).filter("n_known = 0 and score <= 0").count() == 12


def test_language(docs, empty):
    model = language.fit(docs, VOCABULARY, rounds=1)
    rows = {r["doc_id"]: r for r in language.predict(docs, model, ["doc_id", "score"]).select("doc_id", "lang_pred").collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 9, 10)] == ["und", "und", "und", "en", "en", "und", "en"]
    none = language.fit(empty, VOCABULARY)
    assert language.predict(docs, none, ["doc_id"]).filter("lang_pred = 'und' and score = 0").count() == 12
    assert language.predict(empty, model, ["doc_id"]).count() == 0


def test_near_duplicates(docs, empty):
    rows = order_minhash.classes(docs, "doc_id").collect()
    told = {r["doc_id"]: (r["class_id"], r["kept"]) for r in rows}
    assert len(rows) == 12 and told[7] == (6, False) and told[8] == (6, False)
    assert all(told[i] == (i, True) for i in (1, 2, 3, 4, 5, 9, 10)) and told[None] == (None, True)
    kept = order_minhash.deduplicate(docs, "doc_id")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 10]
    assert order_minhash.classes(empty, "doc_id").count() == 0 == order_minhash.deduplicate(empty, "doc_id").count()


def test_encoding(docs, empty):
    own = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(RANKS), special_tokens={})
    rows = prefix_bpe.encode_documents(docs, ["doc_id", "text"], RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == 12
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(r["text"] or "") for r in rows)
    assert prefix_bpe.digest_documents(empty, ["doc_id"], RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, ["doc_id", "rank"], WORDS, ids=True).collect()
    total, by_sequence = 0, defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 4096 * r["piece"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by_sequence) == -(-total // 4096) and sum(r["piece"] == 0 for r in rows) == 12
    assert packing.pack(empty, ["doc_id"], WORDS).count() == 0


def test_packing_in_bounded_memory(spark, monkeypatch):
    """In the pipeline a worker holds a small table of words and a short block of texts, and tells no ids; the pieces are the same."""
    import corpus_pipeline

    rng, held = np.random.default_rng(3), []
    texts = [" ".join(f"{w:x}" for w in rng.integers(0, 1 << 40, 1_500)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, None, "", "x"])), "doc_id long, text string").coalesce(1)
    told = lambda found: sorted(tuple(r) for r in found.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    whole = told(packing.pack(df, ["doc_id"], WORDS))
    monkeypatch.setattr(corpus_pipeline, "PACKED_BLOCK", 20_000, raising=False)
    monkeypatch.setattr(corpus_pipeline, "PACKED_TABLE", 500_000, raising=False)
    keep = packing.pieces

    def pieces(*args):
        made = keep(*args)
        held.append((made.columns, args[-3:]))
        return made

    monkeypatch.setattr(packing, "pieces", pieces)
    assert told(corpus_pipeline.packing_stage(spark, df, "")) == whole
    assert held == [(["kept", "piece", "start", "length", "ids_crc32"], (20_000, 500_000, True))]
    bpe, most = packing.WordBpe(WORDS, 500_000), 0
    for k in range(0, len(texts), 2):
        bpe.encode(texts[k : k + 2])
        most = max(most, bpe._bytes)
    assert most < 500_000 + 2 * 1_500 * 3 * 300


def test_digests(docs, empty):
    rows = digest.compare_neighbours(docs, "doc_id").collect()
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in docs.select("doc_id", "text").collect()))
    expected = Counter()
    for (_, key, text), (*_, after) in zip(order, order[1:] + order[:1]):
        expected[key, len(text), hashlib.sha256(digest.edited(text, after).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in rows) == expected
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert digest.compare_neighbours(empty, "doc_id").count() == 0
    alone = digest.compare_neighbours(docs.filter("doc_id = 4"), "doc_id").first()
    assert alone["near_next"] == 1


def test_quality(docs, empty):
    rows = {r["doc_id"]: r for r in quality.judge(docs, ["doc_id", "kept", "key"]).select("doc_id", "n_words", "base_failed").collect()}
    assert [rows[i]["n_words"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 2, 60_000] and rows[5]["base_failed"]
    assert quality.judge(empty, ["doc_id"]).count() == 0


def test_hosts_shrink(spark):
    rows = [("bad", True)] * 400 + [("good", False)] * 400 + [("one", True)] + [("ok", False)] * 300 + [(None, False)] * 50
    told = {r["host"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert not told["bad"]["host_kept"] and told["good"]["host_kept"] and told[None]["host_kept"]
    assert 0 < told["good"]["host_rate"] < told["one"]["host_rate"] < told["bad"]["host_rate"] < 1


def test_pages(spark, tmp_path):
    page = "<body><p>site</p><article><p>{}</p></article>"
    rows = [(1, "http://a/x", page.format("one")), (2, "http://a/y", page.format("one")), (3, "http://a/y", None), (None, None, "<p>no url"),
            (4, "http://b/", "<p>alone"), (5, "http://b/", "<p>alone"), (6, "http://c/", "<p>alone &amp; " + "x " * 100_000)]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, part int")
    text = {r["page_id"]: r["text"] for r in extract.extract(pages, "page_id").collect()}
    assert text[1] == text[2] == "one" and text[3] == "" and text[None] == "no url" and text[4] == text[5] == ""
    assert len(text[6]) == len("alone & ") + 199_999
    assert extract.extract(pages.limit(0), "page_id").count() == 0
    index = warc.write_archive(pages, "page_id", "url", "html", str(tmp_path / "w"))
    back = {r["record_id"]: r for r in warc.read_archive(index).collect()}
    assert len(back) == 7 and back["urn:x-page:1"]["record_type"] == "revisit" and back["urn:x-page:2"]["payload"].startswith(b"<body>")
    assert back["urn:x-page:"]["payload_bytes"] == 9 and back["urn:x-page:3"]["payload"] == b""
    assert warc.read_archive(warc.write_archive(pages.limit(0), "page_id", "url", "html", str(tmp_path / "e"))).count() == 0


def test_archive_of_equal_rows(spark, tmp_path):
    """Of equal rows one is the response, names differ, and rows that share only their key keep their own payloads."""
    rows = [(1, "http://a/", "same")] * 3 + [(1, "http://a/", "other"), (None, None, "same"), (None, None, None), (None, None, ""), (5, "http://b/", "new")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.read_archive(warc.write_archive(pages.repartition(5), "page_id", "url", "html", str(tmp_path / "w"))).collect()
    names = {r["record_id"]: r for r in back}
    assert len(names) == len(back) == len(rows) and "urn:x-page:5" in names
    by_text = defaultdict(list)
    for r in back:
        by_text[r["payload_digest"]].append(r)
    assert sorted(len(g) for g in by_text.values()) == [1, 1, 2, 4]
    for group in by_text.values():
        (response,) = (r for r in group if r["record_type"] == "response")
        assert all(r["refers_to"] == response["record_id"] for r in group if r is not response)
    (told,) = (r for r in back if r["payload"] == b"same")
    assert told["record_id"].startswith("urn:x-page:1#")


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"),
            (None, None, None, "[INST] \\ y"), (3, 5, "tool", "z" * 100_000)]
    turns = spark.createDataFrame([(*r, 1, "k") for r in rows], "c long, t long, r string, x string, segment int, conversation string")
    back = {r["conversation"]: r for r in chat.read_back(chat.format_conversations(turns, "c", "t", "r", "x")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert back[1]["turns_sha256"] == sha("user\nhi\nassistant\n\nassistant\nb\n") and back[1]["loss_sha256"] == sha("b")
    assert (back[2]["n_turns"], back[2]["loss_chars"], back[2]["in_order"]) == (2, 2, False)
    assert back[None]["turns_sha256"] == sha("\n[INST] \\ y\n") and back[3]["turns_sha256"] == sha("tool\n" + "z" * 100_000 + "\n")
    assert chat.read_back(chat.format_conversations(turns.limit(0), "c", "t", "r", "x")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf_dir, name):
    with duckdb.connect() as db:
        for t in ("documents", "conversations", "embeddings"):
            db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        expected = db.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()[list(expected.columns)]
    order = list(expected.columns)
    pd.testing.assert_frame_equal(
        got.sort_values(order, ignore_index=True), expected.sort_values(order, ignore_index=True), check_dtype=False
    )


def test_near_duplicate_recall(spark, sf_dir):
    """All pairs of the small table whose distinct shingles reach 0.8 are in one class."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    told = {r["doc_id"]: r["class_id"] for r in QUERIES["op2_order_minhash"](spark, sf_dir).collect()}
    shingles = {}
    for r in rows:
        w = (r["text"] or "").lower().split()
        if w:
            shingles[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for a, x in shingles.items():
        for b, y in shingles.items():
            if a < b and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
                likeness = len(x & y) / len(x | y)
                assert likeness < 0.8 or told[a] == told[b]
                assert likeness > 0.2 or told[a] != told[b]


def test_language_held_out(spark, sf_dir):
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = QUERIES["op10_language"](spark, sf_dir).filter("held_out").collect()
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0


def test_warc_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    last = defaultdict(int)
    for p in pages:
        last[p["html"]] = max(last[p["html"]], p["page_id"])
    got = {r["page_id"]: r for r in QUERIES["op9_warc"](spark, sf_dir).collect()}
    for p in pages:
        r, raw = got[p["page_id"]], (p["html"] or "").encode()
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r["payload_bytes"] == len(raw)
        assert (r["record_type"] == "response") == (last[p["html"]] == p["page_id"]) == (r["refers_to"] is None)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}

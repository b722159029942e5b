"""Vector codes, divergence audit and window packing: against brute force, and on nulls, ties, repeats and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leakscan.llm import byte_chunks, divergence, order_minhash, vector_codes, window_packing, word_sort
from leakscan.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


# vector codes


@pytest.mark.parametrize("seed", range(30))
def test_equal_average_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    spread = int(rng.choice([2, 50, 5_000, 2**26]))
    book = rng.integers(-spread, spread, (int(rng.integers(1, 60)), int(rng.integers(1, 9))))
    points = np.concatenate([rng.integers(-spread, spread, (200, book.shape[1])), book])
    code, distance = vector_codes.EqualAverage(book).nearest(points)
    whole = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (code == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_search_skips_entries_of_far_sums():
    book = np.repeat(np.arange(0, 256_000, 1000), 4).reshape(256, 4)
    search = vector_codes.EqualAverage(book)
    assert search.nearest(book + 3)[0].tolist() == list(range(256)) and search.searched < 3 * 256


def _codes_by_hand(rows, parts, entries, rounds):
    """Codes, errors and codebooks of (id, vector) rows, one entry at a time."""
    ints = [(k, [math.floor(1024 * x) for x in v]) for k, v in rows]
    width = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in sorted(ints)[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v in ints:
                mine[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(mine[i]) for c in zip(*mine[i])] if mine[i] else e for i, e in enumerate(books[p])]
    told = [[near(cut(v, p), books[p]) for p in range(parts)] for _, v in ints]
    return [("".join(f"{i:02x}" for _, i in t), sum(d for d, _ in t)) for t in told], books


def test_codes_equal_a_plain_run(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice([0, 1, None])) for i in range(60)]
    rows += [(99, rows[0][1], 0), (99, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS key", "2 AS ints").repartition(3)
    coded, books = vector_codes.compress(df, "vec_id", "embedding", "label", entries=5, rounds=2)
    got = vector_codes.with_label_error(coded).collect()
    plain, plain_books = _codes_by_hand([r[:2] for r in rows], 4, 5, 2)
    assert books.tolist() == plain_books
    assert Counter((r["key"], r["code"], r["error"]) for r in got) == Counter((r[0], *c) for r, c in zip(rows, plain))
    by_label = defaultdict(int)
    for r, (_, error) in zip(rows, plain):
        by_label[r[2]] += error
    assert all(r["label_error"] == by_label[r["label"]] for r in got)
    one = next(r for r in got if r["key"] == 7)
    exact = np.array([math.floor(1024 * x) for x in rows[7][1]])
    assert ((vector_codes.reconstruct(one["code"], books) - exact) ** 2).sum() == one["error"]


def test_codes_of_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5] * 4, [-0.5] * 4, None, [], [nan, 1.0, 1.0, 1.0], [1.0, None, 1.0, 1.0], [inf] * 4, [1e30] * 4, [1.0] * 5, [1.0] * 8]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(vectors)] + [(None, [0.25] * 4, 3)], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(df, "vec_id", "embedding", "label")
    assert {r["key"]: r["code"] for r in vector_codes.with_label_error(coded).collect()} == {0: "00000000", 1: "01010101", None: "02020202"}
    assert books.reshape(-1).tolist() == [512, -512, 256] * 4
    nothing, none = vector_codes.compress(df.limit(0), "vec_id", "embedding", "label")
    assert vector_codes.with_label_error(nothing).count() == 0 and none.shape == (4, 0, 0)


# divergence audit


@pytest.mark.parametrize("seed", range(40))
def test_pointer_sort(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(word_sort, "SMALL", rng.choice([1, 3, 20, 4096]))
    letters = rng.choice(["ab ", "abcdefghij \n", "aBé中 1"])
    texts = [
        ("".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 300]))) + rng.choice(["", "x" * 200, "x" * 199 + "y"])).encode()
        for _ in range(rng.randint(0, 30))
    ]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int32)
    folded, starts, lengths = word_sort.word_starts(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    words = [w.translate(LOWER) for t in texts for w in WORD.findall(t)]
    sort = word_sort.PointerSort(folded, starts, lengths)
    assert [sort.word(i) for i in range(len(starts))] == words
    order = sorted(range(len(words)), key=words.__getitem__)
    assert sort.order.tolist() == order
    assert sort.new.tolist() == [k == 0 or words[order[k]] != words[order[k - 1]] for k in range(len(order))]


def _audit_by_hand(rows, least, top):
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(LOWER).decode() for w in WORD.findall((text or "").encode())]
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang in {k for k, _ in counts}:
        terms = [t for t, n in held[lang].items() if n >= least]
        sources = [s for k, s in counts if k == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in terms) + 2 * len(terms)) for t in terms}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole, own = share(sum((counts[lang, s] for s in sources), Counter())), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(f(own[s][t], own[o][t]) for t in terms), o.encode()) for o in sources if o != s)
            used = sorted((-f(own[s][t], whole[t]), t.encode()) for t in terms if counts[lang, s][t] and own[s][t] > whole[t])
            for part, items in (("pair", pairs), ("term", used[:top])):
                out |= {(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(items, 1)}
    return out


@pytest.mark.parametrize("tile", [256, 2])
def test_audit_equals_a_plain_count(spark, monkeypatch, tile):
    rng = random.Random(8)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TERMS", 3)
    words = ["tree", "Tree", "été", "x1y", "ab-cd", "中文", "é" * 50, "zz"]
    rows = [(" ".join(rng.choices(words, range(1, 9), k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "c", "é", None])) for _ in range(150)]
    rows += [(None, "it", "a"), ("", "it", "b"), ("once only", "it", "c"), rows[0], rows[0], ("lone", "xx", "only")]
    df = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "text string, lang string, source string, n long, term string, docs int").repartition(4)
    got = {tuple(r) for r in divergence.audit(df, least=5, top=3).collect()}
    assert got == _audit_by_hand(rows, 5, 3)
    assert divergence.audit(df.limit(0)).count() == 0


# window packing


def test_ids_are_the_library_s(library):
    assert byte_chunks.faithful(BYTES)
    rng, parts = random.Random(3), ["a", "b", "hello", " ", "  ", "\n", "\t", "1", "'s", "'", "é", "中", " ", "\x1f", "\x1c", ".", "!?", "\r", "᠎", "​", "\x85", "😀"]
    for fast in (True, False):
        chunks = byte_chunks.ByteChunks(BYTES, fast, table_bytes=20_000)
        for _ in range(1500):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
            assert np.frombuffer(chunks.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert chunks.encode("w" * 5000) and all(len(k) <= byte_chunks.LONGEST for k in chunks._table)


def _rooms_by_hand(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [(room, i) for i, room in enumerate(rooms) if room >= x]
        if fit:
            rooms[min(fit)[1]] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_windows_are_those_of_best_fit(seed):
    rng = random.Random(seed)
    capacity, slack = rng.choice([16, 32, 64]), rng.choice([0, 1 / 16, 1 / 4])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, 4), capacity // 2 + 1]) for _ in range(rng.randint(0, 120))]
    counts, seen, rank = Counter(lengths), Counter(), []
    windows = window_packing.best_fit_decreasing(counts, capacity)
    assert sorted(capacity - sum(x * n for x, n in w) for w, bins in windows for _ in range(bins)) == _rooms_by_hand(lengths, capacity)
    for x in lengths:
        rank.append(seen[x])
        seen[x] += 1
    plan = window_packing.Plan(counts, capacity, slack)
    by_piece, by_window = defaultdict(list), defaultdict(list)
    for row, before, size, window, offset in zip(*plan.place(np.array(lengths, dtype=np.int64), np.array(rank, dtype=np.int64))):
        by_piece[row].append((before, size))
        by_window[window].append((offset, size))
    assert sorted(by_window) == list(range(plan.sequences))
    assert [_gapless(by_piece[i]) for i in range(len(lengths))] == lengths
    for places in by_window.values():
        end = _gapless(places)
        assert end <= capacity and (capacity - end <= slack * capacity or end & (end - 1) == 0)


def _gapless(places):
    end = 0
    for start, size in sorted(places):
        assert start == end and size > 0
        end += size
    return end


def _check_windows(rows, texts, library, capacity, ids=False):
    """Padding of packed rows; asserts that they hold each id of each text once."""
    whole = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for k, t in texts.items()}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        mine = whole[r["doc_id"]]
        raw = mine[r["start"] : r["start"] + r["length"]].tobytes()
        assert r["doc_tokens"] == len(mine) and zlib.crc32(raw) == r["ids_crc32"] and (not ids or r["ids"] == raw)
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: _gapless(v) for k, v in by_doc.items()} == {k: len(v) for k, v in whole.items()}
    ends = [_gapless(v) for v in by_window.values()]
    assert max(ends, default=0) <= capacity
    return sum(capacity - e for e in ends if e & (e - 1)), sum(ends)


def test_window_packing(spark, library):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["one", "zwei", "trois\n", "été", "x" * 30]) for _ in range(rng.choice([0, 3, 30, 400]))) for i in range(120)}
    texts |= {200: None, 201: "", 202: "a " * 9_000, None: "no id", 203: " \n\t ", 204: "word " * 15}
    texts |= {i: "same text of one length " * 6 for i in range(300, 340)}
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()], "doc_id long, text string, task int, rank int").repartition(5)
    for capacity, ids in ((64, True), (2048, False)):
        rows = window_packing.pack(df, ["doc_id", "rank"], BYTES, capacity=capacity, ids=ids).collect()
        assert ("ids" in rows[0].asDict()) == ids
        padding, tokens = _check_windows(rows, texts, library, capacity, ids)
        assert padding <= tokens * window_packing.SLACK
    alike = spark.createDataFrame([(i, "tok " * 39) for i in range(50)], "doc_id long, text string")  # 41 of 64: no two fit
    rows = window_packing.pack(alike, ["doc_id"], BYTES, capacity=64).collect()
    padding, _ = _check_windows(rows, {i: "tok " * 39 for i in range(50)}, library, 64)
    assert padding == 0
    assert window_packing.pack(df.limit(0), ["doc_id"], BYTES).count() == 0
    twice = window_packing.pack(alike.filter("doc_id < 2").selectExpr("1L AS doc_id", "text"), ["doc_id"], BYTES).collect()
    assert sum(r["length"] for r in twice) == 2 * twice[0]["doc_tokens"]


def test_window_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    padding, tokens = _check_windows(QUERIES["op13_windows"](spark, sf_dir).collect(), texts, library, 2048)
    assert padding <= tokens / 100


def _groups(count, members, seed):
    """Texts of 400 words: groups of near copies around a common base, whose groups are nearly alike too."""
    rng = np.random.default_rng(seed)

    def changed(words, edits):
        out = list(words)
        for at in rng.choice(len(out), edits, replace=False):
            out[at] = f"new{rng.integers(1 << 40)}"
        return out

    base = [f"w{rng.integers(1 << 40)}" for _ in range(400)]
    centres = [changed(base, int(rng.integers(3, 6))) for _ in range(count)]
    return [" ".join(changed(c, int(rng.integers(1, 5)))) for c in centres for _ in range(members)]


@pytest.mark.parametrize("parts,block", [(1, 4096), (8, 64)])
def test_large_buckets_lose_no_link(spark, monkeypatch, parts, block):
    texts = _groups(16, 20, 5)
    shingles = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    number: dict = {}
    for x in shingles:
        for y in x:
            number.setdefault(y, len(number))
    has = np.zeros((len(texts), len(number)), dtype=np.float32)
    for i, x in enumerate(shingles):
        has[i, [number[y] for y in x]] = 1
    common, size = has @ has.T, has.sum(axis=1)
    alike = common >= 0.8 * (size[:, None] + size[None, :] - common) - 1e-3
    root = np.arange(len(texts))
    while True:
        low = np.where(alike, root[None, :], len(texts)).min(axis=1)
        if (low == root).all():
            break
        root = low
    assert 1 < len(set(root.tolist())) < len(texts)
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        told = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs, "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [told[i] for i in range(len(texts))] == root.tolist()

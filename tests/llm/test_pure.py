"""Parts that need no Spark, against brute force."""

import random
import re
import tracemalloc
from unittest import mock

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leakscan.llm.align import banded_common, common_lines
from leakscan.llm.chat import INSTRUCT, Machine, Parser
from leakscan.llm.digest import edited, fingerprint, likeness
from leakscan.llm.extract import lines_of, main_text
from leakscan.llm.lattice import Lattice
from leakscan.llm.order_minhash import Shingler, forest, labelled, verified
from leakscan.llm.packing import best_fit, plan, reduce
from leakscan.llm.prefix_bpe import Codec, PairTable, PrefixEncoder, read_ranks
from leakscan.llm.quality import text_stats
from leakscan.llm.warc import BundleReader, BundleWriter, parse_record, payload_digest, record_bytes
from leakscan.llm.word_bpe import WordBpe


def _lcs(a, b, band=10**9):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + 1 if x == y and abs(i - j) <= band else 0)
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14), st.integers(0, 6))
def test_alignment(a, b, band):
    pairs = common_lines(a, b)
    assert len(pairs) == _lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
    assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
    for few in (0, 8, 10**9):  # rows of bits, either, equal pairs
        with mock.patch("leakscan.llm.align.FEW", few):
            assert banded_common(a, b, band) == _lcs(a, b, band)


def test_alignment_of_long_texts_is_linear():
    a = np.random.default_rng(3).permutation(500_000).tolist()
    b = [-1, *a[1:-1], -2]
    tracemalloc.start()
    assert banded_common(a, b, 111_000) == len(a) - 2
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_lattice():
    pieces = [bytes([b]) for b in range(97, 101)] + [b" ", b" a", b"ab", b"bc", b" ab", b"abc"]
    lattice, rng = Lattice(pieces), random.Random(1)
    weights = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces))))

    def segmentations(raw):
        if not raw:
            yield []
        for i, p in enumerate(pieces):
            if p and raw.startswith(p):
                yield from ([i, *rest] for rest in segmentations(raw[len(p) :]))

    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(8))).encode() for _ in range(40)]
    counts = np.arange(1.0, 41)
    brute, expected = [], np.zeros(len(pieces))
    for w, n in zip(words, counts):
        shares = [(s, np.exp(weights[s].sum())) for s in segmentations(b" " + w)]
        total = sum(p for _, p in shares)
        brute.append(np.log(total))
        for s, p in shares:
            np.add.at(expected, s, n * p / total)
    assert np.allclose(lattice.log_probability(words, weights), brute)
    assert np.allclose(lattice.expected(words, counts, weights), expected)
    assert np.allclose(lattice.log_probability([b"", b"a" * 5000], weights)[0], weights[4])


RANKS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PAIRS = PairTable(RANKS)
CODEC = Codec(RANKS, public_tokenizers.PATTERN, PAIRS.halves)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abth ering's\n\t éß12٣,.<|>\x1c\x85", max_size=60)))
def test_byte_bpe(text):
    text = text.encode("utf-8", "replace").decode()
    ids = CODEC.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
    assert CODEC.decode(ids).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.text("abthering sx", max_size=300), st.integers(0, 300), st.integers(0, 5), st.text("abthe", max_size=5))
def test_byte_bpe_edits(text, start, length, new):
    raw = text.encode()
    start = min(start, len(raw))
    stop = min(start + length, len(raw))
    encoder = PrefixEncoder(PAIRS, raw)
    assert encoder.ids() == PAIRS.merge(raw)
    encoder.edit(start, stop, new.encode())
    changed = raw[:start] + new.encode() + raw[stop:]
    assert encoder.raw == changed and encoder.ids() == PAIRS.merge(changed)
    encoder.append(b"the end")
    assert encoder.ids() == PAIRS.merge(changed + b"the end")


def test_word_bpe():
    bpe, rng = WordBpe(public_tokenizers.path("word_bpe_49k.json")), random.Random(2)
    alphabet = "ab'sth RE  \n\tÉß12²ª٣,.<|>🎉日本\x1c\x85\xa0\xadſσΣAİ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(600)]
    texts += ["", " ", "x <|endoftext|> y", "a" * 3000, "the cat " * 500]
    expected = bpe.library.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(b, "<u4").tolist() for b in bpe.encode(texts)] == [e.ids for e in expected]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST] "]),
       st.lists(st.sampled_from(list("ab \\\n<>/[]|s") + ["[INST]", "</s>", "<|turn|>", "<<SYS>>", " [/INST]"]), max_size=12).map("".join)), max_size=6))
def test_chat_round_trip(turns):
    machine, parser = Machine(INSTRUCT), Parser(INSTRUCT)
    segments = [s for role, text in turns for s in machine.step(role, text)[1]]
    assert list(parser.turns("".join(text for _, text, _ in segments))) == turns
    learnt = "".join(parser.unescape(text) for _, text, loss in segments if loss)
    assert learnt == "".join(text for role, text in turns if role == "assistant")


def test_chat_order():
    machine = Machine(INSTRUCT)
    assert [machine.step(r, "")[0] for r in ("system", "user", "assistant", "assistant", "user", "tool")] == [
        True, True, True, False, True, False]


@pytest.mark.parametrize("seed", range(30))
def test_packing(seed):
    rng, capacity = random.Random(seed), 40
    counts = {k: rng.randrange(5) for k in range(1, capacity + 1) if rng.random() < 0.5}
    slots, items = plan(counts, capacity), []
    for length, n in counts.items():
        for rank in range(n):
            s = slots[length]
            at = int(np.searchsorted(s["start"], rank, side="right")) - 1
            nth = rank - s["start"][at]
            items.append((s["sequence"][at] + nth // s["each"][at], s["offset"][at] + nth % s["each"][at] * length, length))
    end = {}
    for sequence, offset, length in sorted(items):
        assert offset == end.get(sequence, 0)
        end[sequence] = offset + length
    assert all(e <= capacity for e in end.values()) and len(items) == sum(counts.values())
    fixed, left = reduce(counts, capacity)
    plain = sum(n for _, n in best_fit({k: v for k, v in counts.items() if v}, capacity))
    assert len(end) <= plain and sum(n * len(c) for c, n in fixed) + sum(left.values()) == sum(counts.values())


def test_digest():
    rng = random.Random(4)
    texts = ["", "a", "ab", "abc", " ".join(rng.choice(["the", "of", "and", "to"]) for _ in range(400)), "é" * 5000]
    for t in texts:
        assert likeness(fingerprint(t.encode()), fingerprint(t.encode())) == 1
    a, b = fingerprint(texts[4].encode()), fingerprint(texts[5].encode())
    assert 0 <= likeness(a, b) < likeness(a, fingerprint((texts[4] + " end").encode())) <= 1
    assert edited("abcde", "XYZ") == "abcXY" and edited("abcd", "X") == "abX" and edited("", "X") == ""


def _stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=200, deadline=None)
@given(st.text("ab é \n\t#|\x85\x1c", max_size=60))
def test_text_stats(text):
    assert text_stats(text.encode()) == _stats(text)


def test_near_duplicates_parts():
    shingler, rng = Shingler(), random.Random(6)
    words = [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(300)]
    one = shingler(" ".join(words).encode())
    assert len(one) == 296 and len(shingler(b"two words")) == 1 and not len(shingler(b" \n"))
    assert len(np.unique(labelled(np.repeat(one[:5], 4)))) == 20
    near = words.copy()
    near[150:152] = ["new", "words", "here"]
    far = words.copy()
    far[::9] = ["x"] * len(far[::9])
    a, b, c = (shingler(" ".join(w).encode()) for w in (words, near, far))
    assert verified(a, b, 0.8) and not verified(a, c, 0.8) and verified(a, a, 0.8)
    signatures = np.array([[1, 1, 1, 1], [1, 1, 1, 2], [9, 9, 9, 9], [1, 1, 2, 2]], dtype=np.uint8)
    assert sorted(map(tuple, map(sorted, forest(signatures, 2)))) == [(0, 1), (1, 3)]


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><a>menu</a></nav>"
    "<div class='cookie-notice'>cookies</div><article><h1>A &amp; B</h1><p>one<b>two</b>\n three<p>four"
    "<aside>side</aside><div class='ad'>buy</div><script>x('</p>')</script><form><p>mail</p></form>"
    "<table><tr><td>c1<td>c2</table></article><section id=comments><p>reader</p></section><footer>f</footer>"
)


def test_extract():
    assert main_text(lines_of(PAGE), None) == "A & B onetwo three four c1 c2"
    assert main_text(lines_of(PAGE), lines_of(PAGE)) == "A & B onetwo three four c1 c2"
    bare = "<body><p>site name</p><p>{}</p><p>all rights</p>"
    one, two = lines_of(bare.format("first page")), lines_of(bare.format("second page"))
    assert main_text(one, two) == "first page" and main_text(one, None) == "site name first page all rights"
    assert main_text(lines_of(""), None) == "" and main_text(lines_of("<p unclosed"), None) != "x"


def test_warc_bundles(tmp_path):
    writer, rng = BundleWriter(str(tmp_path), frame_bytes=1000, bundle_bytes=3000), random.Random(1)
    bodies = [rng.randbytes(rng.randrange(600)) for _ in range(60)]
    places = [writer.add(record_bytes(f"urn:x-page:{i}", "http://a/\r\n b", b, payload_digest(b), None)) for i, b in enumerate(bodies)]
    writer.close()
    assert len({p[0] for p in places}) > 1
    for body, (bundle, frame, offset, length) in zip(bodies, places):
        reader = BundleReader(bundle)
        record = parse_record(reader.frame(frame)[offset : offset + length])
        reader.close()
        assert record.payload == body and record.headers["WARC-Target-URI"] == "http://a/%0D%0A%20b"
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(open(places[0][0], "rb"), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1")

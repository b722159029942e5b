"""Operators against brute force on small tables, including their large-input paths."""

import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan.functions.draws import choice, draw, weighted_choice
from leakscan.functions.records import compose_text, default_department, is_external, recommendation
from leakscan.functions.temporal import parse_ts, temporal_features
from leakscan.functions.text import ngrams, normalise, tokens
from leakscan.functions.vector import cosine
from leakscan.operators import profile, vectors
from leakscan.operators.categories import apply_codes, fit_codes
from leakscan.operators.metrics import class_report, confusion, per_class
from leakscan.operators.neighbours import knn
from leakscan.operators.quantiles import exact_quantiles
from leakscan.operators.records import head, validate
from leakscan.operators.sampling import sample_n, stratified_split
from leakscan.operators.vocabulary import TfIdf, fit_vocabulary, term_counts
from leakscan.operators.lookup import bounded_lookup
from leakscan.operators.parallel import spread


def test_normalise_equals_unicodedata(spark):
    texts = ["Ёлка Й ÀÉÎ ñ", "ΆΈ Ώ", "Ӂ é", "Ｆｕｌｌ ① ²", "ẛ̣ ṩ", "простой text", "", "№ 5 ﬁne ½ ㎏ ™…", "한국어 각 가 힣 😄", "Ⅳ ǆ ﷺ |"]
    texts += ["a" + "".join(map(chr, range(low, low + 256))) for low in range(0x80, 0x30000, 256) if not 0xD800 <= low < 0xE000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select(F.lower("t").alias("low"), normalise(F.col("t")).alias("n")).collect():
        plain = "".join(c for c in unicodedata.normalize("NFKD", row["low"]) if not unicodedata.combining(c))
        # Expansions without a word character (… and the like) stay: they are no part of a token.
        words = lambda t: re.findall(r"\w+", t)
        assert words(row["n"]) == words(plain)


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("one two_2 a three",), ("",), ("x",)], "t string").withColumn("w", tokens(F.col("t")))
    rows = df.select(ngrams(F.col("w")).alias("g")).collect()
    assert [r["g"] for r in rows] == [["one", "two_2", "three", "one two_2", "two_2 three"], [], []]


def test_vocabulary_and_weights_equal_the_formula(spark):
    texts = ["кот сидит кот", "кот бежит", "пёс бежит быстро", "пёс сидит", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    docs = []
    for t in texts:
        w = [x for x in (t or "").lower().replace("ё", "е").split() if len(x) > 1]
        docs.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    tf = {x: sum(d.count(x) for d in docs) for d in docs for x in d}
    frequency = {x: sum(x in d for d in docs) for x in tf}
    kept = sorted((x for x in tf if frequency[x] >= 2), key=lambda x: (-tf[x], x))[:3]
    assert [r["term"] for r in fit_vocabulary(df, "t", 3).collect()] == kept
    model = TfIdf.fit(df, "t", 3)
    got = {(r["id"], r["term"]): r["weight"] for r in model.long(df, "id", "t").collect()}
    want = {}
    for i, d in enumerate(docs):
        raw = {x: d.count(x) * (math.log((1 + len(docs)) / (1 + frequency[x])) + 1) for x in kept if x in d}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want.update({(i, x): v / norm for x, v in raw.items()})
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("max_terms, max_frequent", [(5, 100), (5, 2), (30, 100), (500, 1000)])
def test_pruned_vocabulary_equals_full_count(spark, max_terms, max_frequent):
    rng = np.random.default_rng(3)
    words = [f"w{int(i):02d}" for i in rng.zipf(1.6, 1500) % 40]
    df = spark.createDataFrame([(" ".join(words[i : i + 25]),) for i in range(0, 1500, 25)], "t string")
    full = term_counts(df, "t").filter("df >= 2").orderBy(F.desc("tf"), "term").limit(max_terms)
    pruned = fit_vocabulary(df, "t", max_terms, max_frequent=max_frequent)
    assert [tuple(r) for r in pruned.orderBy(F.desc("tf"), "term").collect()] == [tuple(r) for r in full.collect()]


def test_vocabulary_needs_repeated_terms(spark):
    with pytest.raises(ValueError):
        TfIdf.fit(spark.createDataFrame([("one",), ("two",)], "t string"), "t")


def test_time_features(spark):
    df = spark.createDataFrame(
        [(0, "2024-01-15 14:20:00"), (1, "2024-01-15T23:30:00"), (2, "2024-01-13 06:59:59"), (3, "nonsense"), (4, None)], "id int, ts string"
    )
    rows = df.select("id", *temporal_features(parse_ts(F.col("ts")))).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [(14, 0, 0, 0), (23, 1, 0, 0), (6, 1, 5, 1), (12, 0, 2, 0), (12, 0, 2, 0)]


@pytest.mark.parametrize("max_local", [1000, 5])
def test_codes(spark, max_local):
    values = [f"v{i:03d}" for i in range(300)] + ["Ж", "я", "😄", "ﬁ"]
    df = spark.createDataFrame([(v,) for v in values + values[:50]] + [(None,)], "c string")
    codes = fit_codes(df, "c", max_local)
    want = {v: i for i, v in enumerate(sorted({*values, "unknown"}))}
    assert {r["value"]: r["code"] for r in codes.collect()} == want
    seen = spark.createDataFrame([("v001",), (None,), ("new",)], "c string")
    coded = {r["c"]: r["encoded_c"] for r in apply_codes(seen, "c", codes).collect()}
    assert coded == {"v001": want["v001"], None: want["unknown"], "new": -1}


@pytest.mark.parametrize("accuracy", [50_000, 20])
@pytest.mark.parametrize("n", [1, 2, 3, 7, 106, 1000])
def test_quantiles(spark, n, accuracy):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(3, 2, n), 2 if n % 2 else 0)
    hot = rng.random(n) < 0.7
    df = spark.createDataFrame([("a" if h else None, float(v)) for h, v in zip(hot, values)] + [("a", None)], "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, ["v"], qs, ["g"], accuracy).collect()}
    for g, part in (("a", values[hot]), (None, values[~hot])):
        for q in qs:
            if len(part):
                assert got[(g, q)] == pytest.approx(np.quantile(part, q))


def test_sample_and_split_are_exact_and_repeatable(spark):
    df = spark.range(5000).withColumn("c", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare").otherwise("rest"))
    drawn = [r["id"] for r in df.orderBy(draw(F.col("id"), 42), "id").limit(700).collect()]
    for parts in (1, 7):
        moved = df.repartition(parts)
        assert {r["id"] for r in sample_n(moved, 700, "id").collect()} == set(drawn)
        split = stratified_split(moved, "c", "id", 0.2)
        sizes = {r["c"]: (r["n"], r["t"]) for r in split.groupBy("c").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
        assert all(t == math.floor(n * 0.2 + 0.5) for n, t in sizes.values())
    assert sample_n(df, 10_000, "id").count() == 5000
    assert sample_n(df, 0, "id").count() == 0
    assert stratified_split(df, "c", "id", 0.0).filter("is_test").count() == 0


@pytest.mark.parametrize("bound", [1 << 30, 8 * 6 * 10])
def test_neighbours_equal_brute_force(spark, bound):
    rng = np.random.default_rng(0)
    corpus = rng.integers(0, 3, (150, 6)).astype(float)  # many equal distances
    queries = corpus[::4] + rng.integers(0, 2, (38, 6))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)] + [(999, None)], "id int, embedding array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, embedding array<float>")
    got = {}
    for r in knn(c.repartition(5), q, 4, max_query_bytes=bound).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
        assert r["similarity"] == pytest.approx(math.exp(-r["distance"] / 10))
    for i, v in enumerate(queries):
        d = ((corpus - v) ** 2).sum(axis=1)
        best = sorted(range(len(corpus)), key=lambda j: (d[j], j))[:4]
        assert got[i] == [(j, pytest.approx(d[j])) for j in best]


@pytest.mark.parametrize("bound", [1 << 30, 8 * 2 * 2])
def test_neighbours_with_text_ids(spark, bound):
    c = spark.createDataFrame([(f"c{i}", [float(i), 0.0]) for i in range(9)], "key string, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", [float(i), 1.0]) for i in range(9)], "query_id string, embedding array<double>")
    rows = knn(c, q, 2, "key", max_query_bytes=bound).filter("rank = 1").collect()
    assert sorted((r["query_id"], r["id"], r["distance"]) for r in rows) == [(f"q{i}", f"c{i}", 1.0) for i in range(9)]
    mixed = c.unionByName(spark.createDataFrame([("wide", [1.0, 2.0, 3.0])], c.schema)).coalesce(1)
    with pytest.raises(Exception, match="width"):
        knn(mixed, q, 2, "key", max_query_bytes=bound).collect()


def test_neighbours_of_little(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id int, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id int, embedding array<double>")
    rows = knn(c, q, 5).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in rows] == [(1, 0.0), (2, 25.0)]
    assert knn(c.limit(0), q, 5).count() == 0
    assert knn(c, q.limit(0), 5).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([(1, "утечка данных клиента"), (2, "утечка данных клиента"), (3, ""), (4, None)], "id int, t string")
    rows = {r["id"]: np.array(r["embedding"]) for r in vectors.embed_text(df, "t", 64).collect()}
    assert rows[1] == pytest.approx(rows[2]) and np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6)
    assert not rows[3].any() and not rows[4].any() and len(rows[4]) == 64


def test_vector_tables(spark, tmp_path):
    from leakscan.sources.vectors import load_vectors, save_vectors

    a = spark.createDataFrame([(1, [1.0, 2.0], "x")], "id int, embedding array<float>, kind string")
    b = spark.createDataFrame([(2, [3.0, 4.0])], "id int, embedding array<float>")
    both = vectors.add_vectors(a, b)
    assert both.count() == 2
    wide = spark.createDataFrame([(3, [1.0, 2.0, 3.0])], "id int, embedding array<float>")
    with pytest.raises(ValueError):
        vectors.add_vectors(a, wide)
    save_vectors(both, str(tmp_path / "v"))
    assert load_vectors(spark, str(tmp_path / "v"), 2).count() == 2
    with pytest.raises(ValueError):
        load_vectors(spark, str(tmp_path / "v"), 3)


def test_cosine_of_nothing(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(1.0)]


def test_kmeans_keeps_the_cheapest_start(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))], "id int, embedding array<double>")
    best = vectors.kmeans_model(df, 6, n_init=3).summary.trainingCost
    assert all(best <= vectors.kmeans_model(df, 6, seed=42 + i, n_init=1).summary.trainingCost + 1e-9 for i in range(3))


def test_validation(spark):
    ok = ("a@company.com", "b@x.com", "s", "b", None, None, None, "2024-01-01T00:00:00", None, None)
    rows = [ok, (*ok[:2], None, *ok[3:]), (*ok[:3], "", *ok[4:]), (*ok[:2], "s" * 501, *ok[3:]), (*ok[:3], "b" * 10_001, *ok[4:])]
    from leakscan.operators.records import REQUEST_SCHEMA

    valid, rejected = validate(spark.createDataFrame(rows, REQUEST_SCHEMA))
    assert valid.count() == 1
    assert sorted(r["reject_reason"] for r in rejected.collect()) == [
        "body: too long",
        "body: too short",
        "subject: missing",
        "subject: too long",
    ]


def test_record_fields(spark):
    df = spark.createDataFrame([("x@company.com", "", "s", "b"), ("x@COMPANY.com", None, "s", "b")], "r string, d string, s string, b string")
    rows = df.select(is_external(F.col("r")).alias("e"), default_department(F.col("d")).alias("d"), compose_text(F.col("s"), F.col("b")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [(False, "Unknown", "s. b"), (True, "Unknown", "s. b")]


@pytest.mark.parametrize(
    "kind, level, n, external, ends",
    [
        ("usb", "Low", 0, False, "плановом аудите"),
        ("usb", "Odd", 0, False, "Проверить инцидент"),
        ("email", "Odd", 2, False, "Проверить инцидент. Обнаружено 2 PII."),
        ("email", "High", 0, False, "часа. Рекомендуется проверить получателя и содержимое вложений."),
        ("usb", "High", 1, True, "Обнаружено 1 PII. Отправка внешнему получателю - повышенный риск."),
    ],
)
def test_recommendation(spark, kind, level, n, external, ends):
    df = spark.createDataFrame([(kind, level, n, external)], "k string, s string, n int, e boolean")
    assert df.select(recommendation(*map(F.col, "ksne"))).first()[0].endswith(ends)


def test_metrics_of_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b")], "y string, p string")
    assert confusion(df, "y", "p").count() == 9
    assert confusion(df, "y", "p", ["a", "z"]).agg(F.sum("n")).first()[0] == 1
    got = {r["class"]: (r["precision"], r["recall"], r["f1"]) for r in per_class(df, "y", "p").collect()}
    assert got == {"a": (1.0, 0.5, pytest.approx(2 / 3)), "b": (0.0, 0.0, 0.0), "c": (0.0, 0.0, 0.0)}
    report = {r["label"]: r for r in class_report(df, "y", "p").collect()}
    assert report["accuracy"]["f1"] == pytest.approx(1 / 3) and report["macro avg"]["recall"] == pytest.approx(1 / 6)
    assert report["weighted avg"]["support"] == 3


def test_group_stats_keep_empty_classes(spark):
    df = spark.createDataFrame([("High", 3), ("High", 5), ("Other", 1)], "s string, v int")
    rows = profile.group_stats(df, "s", "v", ["Low", "High"]).collect()
    assert [tuple(r) for r in rows] == [("Low", 0, 0, None, None, None), ("High", 1, 2, 4.0, 4.0, 5)]


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert profile.missing(df).count() == 0
    assert {r["column_name"]: r["count"] for r in profile.describe_numeric(df).collect()} == {"b": 0}
    assert profile.distribution(df, "a").count() == 0


def test_weighted_choice_shares(spark):
    u = draw(F.col("id"), 1)
    df = spark.range(20_000).select(weighted_choice(u, {"a": 0.5, "b": 0.3, "c": 0.2}).alias("w"), choice(u, ["x", "y"]).alias("c"))
    shares = {r["w"]: r["count"] / 20_000 for r in df.groupBy("w").count().collect()}
    assert all(abs(shares[k] - s) < 0.02 for k, s in {"a": 0.5, "b": 0.3, "c": 0.2}.items())
    assert df.filter("c is null").count() == 0


def test_head_needs_an_order(spark):
    with pytest.raises(ValueError):
        head(spark.range(3), 2)


def test_lookup_bound(spark):
    df = spark.range(20)
    assert bounded_lookup(df, 10).inputFiles()  # read back from the shared folder
    assert not bounded_lookup(df, 20).inputFiles()
    assert bounded_lookup(df, 20, max_bytes=20).count() == 20


def test_spread_only_small_inputs(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id") is wide
    assert spread(wide.coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism

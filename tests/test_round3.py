"""Rejected records, distributed selection, boosted trees, pivot search and stored indexes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan.operators.quantiles import exact_quantiles
from leakscan.operators.records import REQUEST_SCHEMA
from leakscan.plans.scoring import scan_messages, with_rejects
from leakscan.streaming.score import read_output, run_stream_with_rejects, write_batch


def _requests(spark, n, start=0):
    """Every third record has no body, every fifth an overlong subject."""
    rows = [
        (f"u{i}@company.com", "p@partner.org", "s" * (501 if i % 5 == 0 else 5), None if i % 3 == 0 else f"text {i}", None, None, None, "2024-02-03T10:00:00", "IT", None)
        for i in range(start, start + n)
    ]
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def _expected(n, start=0):
    rejected = {f"u{i}@company.com": "body: missing" if i % 3 == 0 else "subject: too long" for i in range(start, start + n) if i % 3 == 0 or i % 5 == 0}
    return {f"u{i}@company.com" for i in range(start, start + n)} - set(rejected), rejected


def _told(scored, rejected):
    return {r["user_email"] for r in scored.collect()}, {r["user_email"]: r["reject_reason"] for r in rejected.collect()}


def test_batch_keeps_rejected_records(spark):
    df = _requests(spark, 31)
    scored, rejected = with_rejects(df, scan_messages)
    assert _told(scored, rejected) == _expected(31)
    assert rejected.columns == [*df.columns, "reject_reason"] and scored.count() + rejected.count() == 31
    for part in with_rejects(df.limit(0), scan_messages):
        assert part.count() == 0


def test_repeated_batch_adds_nothing(spark, tmp_path):
    target, rejects = str(tmp_path / "scored"), str(tmp_path / "rejected")
    write_batch(_requests(spark, 4), 0, scan_messages, target, rejects)  # a first attempt that saw less
    for number, start in ((0, 0), (1, 20), (0, 0)):
        write_batch(_requests(spark, 20, start), number, scan_messages, target, rejects)
    outputs = read_output(spark, target), read_output(spark, rejects)
    assert _told(*outputs) == _expected(40)
    assert sum(o.count() for o in outputs) == 40


def test_stream_keeps_rejected_records(spark, tmp_path):
    folder, target, rejects, checkpoint = (str(tmp_path / x) for x in ("in", "scored", "rejected", "checkpoint"))
    _requests(spark, 30).repartition(3).write.parquet(folder)
    source = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    run_stream_with_rejects(source, scan_messages, target, rejects, checkpoint, 120)
    _requests(spark, 9, 30).write.mode("append").parquet(folder)
    run_stream_with_rejects(source, scan_messages, target, rejects, checkpoint, 120)
    outputs = read_output(spark, target), read_output(spark, rejects)
    assert _told(*outputs) == _expected(39)
    assert sum(o.count() for o in outputs) == 39 and outputs[0].select("batch_id").distinct().count() > 1


@pytest.mark.parametrize("buckets", [32, 4096])
def test_selection_over_hard_values(spark, buckets):
    rng = np.random.default_rng(1)
    columns = {
        "far": np.concatenate([rng.normal(0, 1e-9, 300), [1e300, -1e300, 5e-324]]),
        "zeros": np.concatenate([np.zeros(280), rng.normal(0, 1, 23)]),
        "close": 1.0 + np.arange(303) * 2.0**-52,
        "ends": np.concatenate([[np.inf, -np.inf], rng.lognormal(0, 20, 301)]),
        "same": np.full(303, -7.5),
    }
    df = spark.createDataFrame([tuple(float(c[i]) for c in columns.values()) + ("a.b",) for i in range(303)], ", ".join(f"`{c}` double" for c in columns) + ", g string")
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    for by in ((), ("g",)):
        got = {(r["column"], r["q"]): r["value"] for r in exact_quantiles(df, list(columns), qs, by, buckets).collect()}
        assert len(got) == len(columns) * len(qs)
        for name, values in columns.items():
            ordered = np.sort(values)
            for q in qs:
                at = q * 302
                low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
                assert got[name, q] == (low if low == high else low + (high - low) * (at - np.floor(at)))
    none = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert exact_quantiles(none, ["v"], [0.5]).count() == 0 == exact_quantiles(df.limit(0), ["far"], [0.5]).count()


def test_selection_plan_has_no_sketch(spark, capsys):
    df = spark.range(100_000).select((F.col("id") * 7 % 1000).cast("double").alias("v"), F.lit("x").alias("g"))
    out = exact_quantiles(df, ["v"], [0.5], ["g"])
    assert out.first()["value"] == 499.5
    out.explain()
    assert "percentile" not in capsys.readouterr().out


# pivot search and stored indexes


def _clusters(spark, n, width=6, centres=12, seed=3):
    rng = np.random.default_rng(seed)
    where = rng.normal(0, 20, (centres, width))
    of = np.where(rng.random(n) < 0.35, 0, rng.integers(0, centres, n))  # one cluster holds a third
    vectors = np.round(where[of] + rng.normal(0, 0.3, (n, width)), 3)
    vectors[n // 2 : n // 2 + 40] = vectors[0]  # ties
    return spark.createDataFrame([(i, v.tolist(), f"m{i}") for i, v in enumerate(vectors)], "id long, embedding array<double>, note string")


@pytest.fixture(scope="module")
def clusters(spark):
    return _clusters(spark, 1500)


def _hits(df):
    return {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in df.collect()}


def test_pivot_search_equals_all_pairs(spark, clusters, monkeypatch):
    from leakscan.operators import pivots
    from leakscan.operators.neighbours import knn

    monkeypatch.setattr(pivots, "BLOCK_ROWS", 100)
    monkeypatch.setattr(pivots, "BLOCK_QUERIES", 30)
    odd = spark.createDataFrame([(5000, [0.0] * 6), (5001, None), (None, [1.0] * 6)], "query_id long, embedding array<double>")
    asked = clusters.filter("id % 5 = 0").select((F.col("id") + 10_000).alias("query_id"), "embedding").unionByName(odd)
    dealt = pivots.deal(clusters, pivots.choose_pivots(clusters, "id", "embedding"), "id", "embedding", metadata=False)
    sizes = pivots.pivots_of(pivots.choose_pivots(clusters, "id", "embedding"), pivots.pivot_sizes(dealt))
    found, compared = pivots.search(dealt, sizes, asked, 7)
    assert _hits(found) == _hits(knn(clusters, asked, 7))
    assert compared.agg(F.sum("compared")).first()[0] < 0.5 * 301 * 1500  # more than half of the pairs are skipped
    few = clusters.limit(3)
    assert _hits(pivots.pivot_knn(few, asked, 7)) == _hits(knn(few, asked, 7))
    assert pivots.pivot_knn(clusters.limit(0), asked, 7).count() == 0 == pivots.pivot_knn(clusters, asked.limit(0), 7).count()


def test_stored_index(spark, clusters, tmp_path):
    from leakscan.operators.neighbours import knn
    from leakscan.sources.vector_index import VectorIndex, build_vector_index

    path = str(tmp_path / "index")
    build_vector_index(clusters.filter("id < 700"), path)
    files = {str(f) for f in (tmp_path / "index").rglob("*.parquet")}
    for _ in range(2):  # the second run of a batch replaces the first
        VectorIndex(spark, path).append(clusters.filter("id >= 700"), "late")
        assert files <= {str(f) for f in (tmp_path / "index").rglob("*.parquet")}
    index = VectorIndex(spark, path)
    assert index.rows().count() == 1500 and index.dimension == 6
    asked = clusters.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = index.search(asked, 4, metadata=True)
    assert _hits(found) == _hits(knn(clusters, asked, 4))
    assert found.filter(F.col("note") != F.concat(F.lit("m"), "id")).count() == 0
    with pytest.raises(Exception, match="width"):
        index.append(spark.createDataFrame([(9999, [1.0])], "id long, embedding array<double>"), "wrong")
    nothing = build_vector_index(clusters.limit(0), str(tmp_path / "empty"))
    assert nothing.search(asked).count() == 0
    with pytest.raises(ValueError):
        nothing.append(clusters, "x")


# boosted trees


def _learnable(spark, n=400, seed=1):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, 4)), 3)
    x[:, 3] = 7.0  # a constant feature
    y = np.where(x[:, 0] > 0.3, "a", np.where(x[:, 1] * x[:, 0] > 0, "b", "c"))
    df = spark.createDataFrame([(i, v.tolist(), str(k), 1.0 + i % 3) for i, (v, k) in enumerate(zip(x, y))], "id long, x array<double>, y string, w double")
    return df.withColumn("features", array_to_vector("x"))


def _by_hand(x, y, w, model):
    """Probabilities of the same boosting over the same bins, one node at a time."""
    from leakscan.operators.boosting import _to_bins, softmax

    p, bins = model.params, _to_bins(x, model.edges)
    margins = np.tile(model.start, (len(x), 1))
    for _ in range(p.rounds):
        prob, step = softmax(margins), np.zeros_like(margins)
        for k, label in enumerate(model.labels):
            g, h = (prob[:, k] - (y == label)) * w, prob[:, k] * (1 - prob[:, k]) * w

            def grow(rows, depth, value, step=step, g=g, h=h, k=k):
                best = (1e-9, None, None)
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + p.penalty)
                for f in range(x.shape[1]) if depth < p.depth else ():
                    for cut in range(p.bins - 1):
                        left, right = rows & (bins[:, f] <= cut), rows & (bins[:, f] > cut)
                        if h[left].sum() >= p.least and h[right].sum() >= p.least:
                            won = score(left) + score(right) - score(rows)
                            if won > best[0] + 1e-7:
                                best = (won, f, cut)
                if best[1] is None:
                    step[rows, k] = value
                    return
                for side in (bins[:, best[1]] <= best[2], bins[:, best[1]] > best[2]):
                    m = rows & side
                    grow(m, depth + 1, -p.rate * g[m].sum() / (h[m].sum() + p.penalty))

            grow(np.ones(len(x), bool), 0, 0.0)
        margins += step
    return softmax(margins)


def test_boosted_trees_equal_a_plain_run(spark, monkeypatch):
    from leakscan.operators import boosting

    monkeypatch.setattr(boosting, "REFRESH", 2)
    params = boosting.BoostParams(rounds=3, depth=2, bins=8)
    df = _learnable(spark)
    model = boosting.fit_boosted(df, "y", params, weight="w")
    rows = df.orderBy("id").collect()
    x, y, w = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), np.array([r["w"] for r in rows])
    assert model.labels == ["a", "b", "c"] and len(model.edges[3]) == 0 and all(len(e) == 7 for e in model.edges[:3])
    np.testing.assert_allclose(model.probabilities(x), _by_hand(x, y, w, model), atol=1e-5)
    other = boosting.fit_boosted(df.repartition(7, "w"), "y", params, weight="w")
    assert (other.trees.value == model.trees.value).all() and (other.trees.feature == model.trees.feature).all()


def test_boosted_trees_learn_save_and_load(spark, tmp_path):
    from leakscan.operators.boosting import BoostedModel, BoostParams, fit_boosted
    from pyspark.ml.functions import vector_to_array

    df = _learnable(spark).withColumn("y", F.when(F.col("id") == 3, None).otherwise(F.col("y")))
    model = fit_boosted(df, "y", BoostParams(rounds=6, depth=3, rate=0.5))
    out = model.transform(df, "y", "told")
    assert out.filter(F.col("told") == F.col("y")).count() > 0.95 * 400 and out.count() == 400
    assert out.select(F.aggregate(vector_to_array("y_probability"), F.lit(0.0), lambda a, b: a + b).alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    assert abs(model.importances().sum() - 1) < 1e-9 and model.importances()[3] == 0
    model.save(spark, str(tmp_path / "m"))
    again = BoostedModel.load(spark, str(tmp_path / "m")).transform(df, "y", "told")
    assert again.select("id", "told").exceptAll(out.select("id", "told")).count() == 0
    assert model.transform(df.limit(0), "y", "told").count() == 0
    with pytest.raises(ValueError):
        fit_boosted(df.withColumn("y", F.lit(None).cast("string")), "y")


def test_leak_model_of_boosted_trees(spark):
    from leakscan.operators.synth import synth_incidents
    from leakscan.plans import models as M
    from leakscan.plans.features import FeatureConfig
    from leakscan.session import work_path

    incidents = synth_incidents(spark, 300)
    model = M.train(incidents, "incident_id", config=FeatureConfig(max_terms=20), params=M.TreeParams.boosted(3, 2))
    assert model.metrics["incident_type_accuracy"] > 0.9
    path = work_path(spark, "boosted")
    M.save_model(spark, model, path)
    columns = ["incident_id", *M.PREDICTED.values(), *M.CONFIDENCE.values()]
    again = M.load_model(spark, path)
    assert M.score(incidents, model).select(columns).exceptAll(M.score(incidents, again).select(columns)).count() == 0
    assert abs(sum(r["importance"] for r in M.importance(spark, model, "severity").collect()) - 100) < 1e-6
    assert {"rounds", "depth"} <= {r["name"] for r in M.model_info(spark, model).filter("kind = 'severity'").collect()}
    assert set(M.log_loss(incidents, model)) == {"incident_type", "severity"}

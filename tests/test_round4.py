"""Work that is bounded in a task's memory: search by bundles of pivots."""

import numpy as np
from pyspark.sql import functions as F


def test_query_travels_once_for_each_bundle(spark, monkeypatch):
    from leakscan.operators import pivots
    from leakscan.operators.neighbours import knn

    monkeypatch.setattr(pivots, "BLOCK_ROWS", 300)
    rounds, keep = [], pivots.materialise

    def counted(df, name):
        out = keep(df, name)
        if name == "pivot-asked":
            rounds.append(out.count())
        return out

    monkeypatch.setattr(pivots, "materialise", counted)
    vectors = np.random.default_rng(4).normal(0, 1, (900, 16))  # nothing can be skipped: each query visits all 30 pivots
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    asked = df.select((-F.col("id")).alias("query_id"), "embedding")
    told = lambda found: {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in found.collect()}
    assert told(pivots.pivot_knn(df, asked, 5)) == told(knn(df, asked, 5))
    assert max(rounds) <= 900 * 6


def test_training_partitions_are_bounded(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    from leakscan.operators.synth import synth_incidents
    from leakscan.plans import models as M

    monkeypatch.setattr(M, "TRAINED_ROWS", 50, raising=False)
    sizes, fit = [], RandomForestClassifier.fit

    def counted(self, df, *args):
        sizes.append(df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first())
        return fit(self, df, *args)

    monkeypatch.setattr(RandomForestClassifier, "fit", counted)
    whole = synth_incidents(spark, 1000).coalesce(1)  # one task's rows, however many
    M.train(whole, "incident_id", params=M.TreeParams(trees=2, depth=2))
    assert len(sizes) == 2 and all(s[0] > 700 and s[1] <= 100 for s in sizes), sizes


def test_csv_files_are_bounded(spark, tmp_path):
    from leakscan.sources.files import read_csv, write_csv

    df = spark.range(0, 1000, 1, 1).select("id", F.concat(F.lit('a "quoted"\nline '), "id").alias("text"))
    write_csv(df, str(tmp_path / "t.csv"), rows_per_file=100)
    assert len(list((tmp_path / "t.csv").glob("part-*.csv"))) == 10
    back = read_csv(spark, str(tmp_path / "t.csv"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())

"""Training reads each text once; quick classes and joined words change nothing; long expression lists are compiled."""

import unicodedata

from pyspark.sql import functions as F

from leakscan.functions.text import accent_tables, join_words, normalise, split_words, tokens


def test_training_reads_each_text_once(spark):
    from leakscan.operators.synth import synth_incidents
    from leakscan.plans import models as M

    read = spark.sparkContext.accumulator(0)

    def noted(text):
        read.add(1)
        return text

    noted = F.udf(noted, "string").asNondeterministic()
    incidents = synth_incidents(spark, 300).localCheckpoint()
    M.train(incidents.withColumn("description", noted("description")), "incident_id", params=M.TreeParams(trees=2, depth=2))
    assert read.value == 300


def test_read_texts_give_the_same_model_and_vectors(spark):
    from leakscan.operators.synth import synth_incidents
    from leakscan.plans.features import FeatureConfig, FeatureExtractor, read_texts

    rows = synth_incidents(spark, 200).drop("contains_pii").coalesce(2)
    odd = rows.limit(3).withColumn("description", F.lit(None).cast("string")).withColumn("incident_id", F.concat(F.lit("x"), "incident_id"))
    table = rows.unionByName(odd).localCheckpoint()
    for config in (FeatureConfig(max_terms=40), FeatureConfig(use_pii=False, category_col=None, timestamp_col=None)):
        read = read_texts(table, config, ("incident_id",)).localCheckpoint()
        assert "description" not in read.columns
        plain, kept = FeatureExtractor(config).fit(table), FeatureExtractor(config).fit(read)
        assert (plain.tfidf.terms, plain.tfidf.weights) == (kept.tfidf.terms, kept.tfidf.weights)
        told = lambda df: {r["incident_id"]: r["features"] for r in df.select("incident_id", "features").collect()}
        assert told(plain.transform(table)) == told(kept.transform(read))


def test_rare_pattern_passes_no_character_that_expands(spark):
    tables = accent_tables()
    chars = [c for c in map(chr, [*range(1, 0x600), 0x2026, 0xAC00, 0xFB01, 0x1F100])]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    calm = {r["c"] for r in df.filter(~F.rlike("c", F.lit(tables.rare_pattern))).collect()}
    assert calm == {c for c in chars if (ord(c) < 0x100 or 0x400 <= ord(c) <= 0x52F) and c not in tables.wide}
    texts = ["Ёлка й", "ﬁn ½", "straße Ærø", "한국 x", "", None, "naïve Ĳ", "a_b 12"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", normalise(F.col("t")).alias("n"))
    want = ["елка и", "fin 1⁄2", "straße ærø", unicodedata.normalize("NFKD", "한국 x"), "", "", "naive ij", "a_b 12"]
    assert [r["n"] for r in got.orderBy("i").collect()] == want


def test_joined_words_come_back(spark):
    df = spark.createDataFrame([("one two  two",), ("",), (None,), ("x",), ("ab",)], "t string")
    words = tokens(normalise(F.col("t")))
    got = df.select(words.alias("w"), join_words(words).alias("j")).select("w", split_words(F.col("j")).alias("b")).collect()
    assert all(r["w"] == r["b"] for r in got) and [len(r["w"]) for r in got] == [3, 0, 0, 0, 1]


def test_limit_of_methods_holds_for_the_block_only(spark):
    from leakscan.session import compiled

    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        with compiled(spark):
            assert int(spark.conf.get(key)) == 8000
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(key) == before

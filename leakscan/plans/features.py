"""Feature vectors of incidents: detection, TF-IDF, category code, time and flags, in that order."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions.detect import PII_FEATURES, pii_features
from leakscan.functions.temporal import TEMPORAL_FEATURES, bool_feature, parse_ts, temporal_features
from leakscan.operators.categories import apply_codes, fit_codes
from leakscan.operators.findings import with_pii
from leakscan.operators.vocabulary import TfIdf, read_words

FLAG_FEATURES = ("is_external_recipient", "contains_pii")
#: What ``read_texts`` adds: whether anything was found, the detection features, the words.
FOUND, WORDS = "_has_pii", "_words"
HELD = (FOUND, *(f"_{name}" for name in PII_FEATURES), WORDS)


@dataclass(frozen=True)
class FeatureConfig:
    """Input columns and switches. A column that is named must exist; None leaves its features out."""

    text_col: str = "description"
    category_col: str | None = "department"
    timestamp_col: str | None = "timestamp"
    external_col: str | None = "is_external_recipient"
    contains_col: str | None = "contains_pii"
    use_pii: bool = True
    rules: str = "base"
    max_terms: int = 100
    min_df: int = 2

    def required(self) -> list[str]:
        """Columns a table must have. The contains-PII flag is derived from detection where it is absent."""
        return [c for c in (self.text_col, self.category_col, self.timestamp_col, self.external_col) if c]


def read_texts(df: DataFrame, config: FeatureConfig, keep: Sequence[str] = ()) -> DataFrame:
    """Adds what features take from a text whatever the fit, for a table that is fitted and transformed in several passes.

    Detection and words cost far more than the rest of a feature vector. ``fit`` and ``transform`` read the columns where they are.
    Of the table's own columns those stay that features or ``keep`` name; the text goes.
    """
    _require(df, config)
    c = config
    wanted = {*keep, c.category_col, c.timestamp_col, c.external_col, c.contains_col}
    given = [name for name in df.columns if name in wanted]
    out = with_pii(df, config.text_col, config.rules, into="_pii")
    found = F.col("_pii")
    flags = [flag.alias(f"_{name}") for flag, name in zip(pii_features(found), PII_FEATURES, strict=True)]
    return out.select(*given, found["has_pii"].alias(FOUND), *flags, read_words(config.text_col).alias(WORDS))


def _is_read(df: DataFrame) -> bool:
    return set(HELD) <= set(df.columns)


class FeatureModel:
    """Fitted vocabulary and category codes. ``feature_names`` is the layout of the vector by construction."""

    def __init__(self, config: FeatureConfig, tfidf: TfIdf, codes: DataFrame | None):
        self.config, self.tfidf, self.codes = config, tfidf, codes

    @property
    def feature_names(self) -> list[str]:
        c = self.config
        return [
            *(PII_FEATURES if c.use_pii else ()),
            *(f"tfidf_{t}" for t in self.tfidf.terms),
            *((f"encoded_{c.category_col}",) if c.category_col else ()),
            *(TEMPORAL_FEATURES if c.timestamp_col else ()),
            *((FLAG_FEATURES[0],) if c.external_col else ()),
            *((FLAG_FEATURES[1],) if c.contains_col else ()),
        ]

    def transform(self, df: DataFrame, into: str = "features", keep_pii: str | None = None) -> DataFrame:
        """Adds the feature vector; ``keep_pii`` names a column that keeps the detection struct. Columns of ``read_texts`` go."""
        c = self.config
        if read := _is_read(df) and not keep_pii:
            given = [g for g in df.columns if g not in HELD]
            out = self.tfidf.transform(df, WORDS, into="_tfidf", joined=True)
        else:
            _require(df, c)
            given = df.columns
            out = with_pii(df, c.text_col, c.rules, into="_pii")
            out = self.tfidf.transform(out, c.text_col, into="_tfidf")
        if c.category_col:
            out = apply_codes(out, c.category_col, self.codes, into="_code")

        parts = []
        if c.use_pii:
            parts += [F.col(f"_{name}") for name in PII_FEATURES] if read else pii_features(F.col("_pii"))
        parts.append(F.col("_tfidf"))
        if c.category_col:
            parts.append(F.col("_code"))
        if c.timestamp_col:
            parts += temporal_features(parse_ts(F.col(c.timestamp_col)))
        if c.external_col:
            parts.append(bool_feature(F.col(c.external_col)))
        if c.contains_col:
            flag = F.col(c.contains_col) if c.contains_col in given else F.col(FOUND) if read else F.col("_pii")["has_pii"]
            parts.append(bool_feature(flag))

        inputs = [f"_f{i}" for i in range(len(parts))]
        out = out.withColumns({name: part for name, part in zip(inputs, parts)})
        out = VectorAssembler(inputCols=inputs, outputCol=into).transform(out)
        kept = [F.col(g) for g in given]
        if keep_pii:
            kept.append(F.col("_pii").alias(keep_pii))
        return out.select(*kept, into)

    def save(self, path: str, spark: SparkSession) -> None:
        config = json.dumps({**asdict(self.config), "low": self.tfidf.low, "high": self.tfidf.high})
        spark.createDataFrame([(config,)], "config string").write.mode("overwrite").parquet(f"{path}/config")
        terms = list(zip(self.tfidf.terms, self.tfidf.weights))
        spark.createDataFrame(terms, "term string, idf double").write.mode("overwrite").parquet(f"{path}/vocabulary")
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        settings = json.loads(spark.read.parquet(f"{path}/config").first()["config"])
        low, high = settings.pop("low"), settings.pop("high")
        config = FeatureConfig(**settings)
        rows = spark.read.parquet(f"{path}/vocabulary").collect()
        tfidf = TfIdf([r.term for r in rows], [r.idf for r in rows], low, high)
        codes = spark.read.parquet(f"{path}/codes") if config.category_col else None
        return cls(config, tfidf, codes)


class FeatureExtractor:
    """Estimator of :class:`FeatureModel`."""

    def __init__(self, config: FeatureConfig | None = None):
        self.config = config or FeatureConfig()
        self.model: FeatureModel | None = None

    def fit(self, df: DataFrame) -> FeatureModel:
        c = self.config
        if _is_read(df):
            tfidf = TfIdf.fit(df, WORDS, c.max_terms, c.min_df, joined=True)
        else:
            _require(df, c)
            tfidf = TfIdf.fit(df, c.text_col, c.max_terms, c.min_df)
        codes = fit_codes(df, c.category_col) if c.category_col else None
        self.model = FeatureModel(c, tfidf, codes)
        return self.model

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("not fitted: call fit first")
        return self.model.transform(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    @property
    def feature_names(self) -> list[str]:
        if self.model is None:
            raise ValueError("not fitted: call fit first")
        return self.model.feature_names


def _require(df: DataFrame, config: FeatureConfig) -> None:
    absent = [c for c in config.required() if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")

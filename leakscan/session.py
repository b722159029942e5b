"""Session helpers: recommended settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "leakscan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    The zone is pinned because hours and weekdays are read off timestamps. Shuffle partition counts are left to
    AQE, which coalesces them to the data.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Root of the folder all executors can reach, as the session names it.

    Where the session names none, a local master (tests on one machine) gets a temporary folder, which is then set on
    the context so that later calls agree; on a cluster that is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leakscan-"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a method beyond which HotSpot never compiles it.
_COMPILED_BYTES = 8000


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """For actions over very long lists of expressions: those run in small methods that the JVM compiles.

    Fused into one method of a whole stage they pass its bound and are interpreted for every row.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(min(int(before), _COMPILED_BYTES)))
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back.

    For results that several later passes read and that are dear to compute: the lineage ends here, so a lost executor
    costs a re-read and not a recomputation.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

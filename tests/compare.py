"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> list[str]:
    """Differences found: column names, kinds of type, rows."""
    problems = []
    relation = con.execute(sql)
    duck_cols, duck_rows = rows_of([c[0] for c in relation.description], relation.fetchall())
    duck_types = {c[0]: str(c[1]) for c in relation.description}
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    names = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for c, t in df.dtypes:
        if duck_types.get(c) != names.get(t, t):
            problems.append(f"type of {c}: {t} / {duck_types.get(c)}")
    if spark_cols != duck_cols:
        problems.append(f"columns {spark_cols} / {duck_cols}")
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} / {len(duck_rows)}")
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {str(bad[0])[:600]}")
    return problems

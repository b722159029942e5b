"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every result is computed in full and thrown away, so the figures hold no transfer to Python.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from leakscan.catalog import QUERIES  # noqa: E402
from leakscan.session import build_session  # noqa: E402

HEADLINE = [
    "pii_scan",
    "pii_scan_extended",
    "pii_findings",
    "risk_by_source",
    "recommend",
    "temporal_features",
    "category_apply",
    "vocabulary",
    "tfidf_long",
    "describe",
    "group_stats",
    "five_number",
    "missing_report",
    "sample_n",
    "stratified_split",
    "class_report",
    "knn",
    "knn_similar",
    "similar_documents",
    "kmeans",
    "csv_roundtrip",
    "synth_incidents",
    "synth_enhanced",
    "train_score",
    "evaluate_model",
    "score_requests",
    "stream_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "leakscan-bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["typed_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the engine
    seconds, errors = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # one failing query must not cost the figures of the others
            errors[name] = f"{type(error).__name__}: {error}".split("\n")[0][:200]
        else:
            seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
                **({"errors": errors} if errors else {}),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

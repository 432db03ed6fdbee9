"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder with the tables; BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from queries.catalog import QUERIES  # noqa: E402
from redpen.session import build_session  # noqa: E402

HEADLINE = (
    "tokenize",
    "merlin_like",
    "wi_like",
    "canonical_union",
    "prepare_train",
    "extract_edits",
    "token_distance",
    "classify_edits",
    "score_strict",
    "score_by_category",
    "predict_unique",
    "fit_lexicon",
    "predict_lexicon",
    "highlight_segments",
    "check",
    "m2_roundtrip",
    "extract_edits_rules",
    "score_by_families",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "redpen-bench",
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8), BENCH_RUNS the
warm runs per query, of which the median counts (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suite import QUERIES  # noqa: E402

HEADLINES = [
    "map_customer", "conform_union_parties", "integrate_sources", "t_chain", "n_variant_name", "q_compare", "q_group_nested",
    "q_text_numbers", "q_many_rules", "g_sets", "g_violations", "g_summary", "nest_last_distinct", "nest_sets", "nest_structs",
    "nest_two_level", "nest_hot_keys", "variant_records", "flatten_product", "merge_spellings", "merge_into_lists",
    "correlated_lines", "lookup_left", "row_ordinals", "keyword_documents", "release_variants", "xml_by_rules", "json_roundtrip",
    "stream_equals_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        started = time.perf_counter()
        # The noop sink computes every row and column without collecting them.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    spent = {}
    for name in names:
        once(name)
        spent[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    total = round(sum(spent.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

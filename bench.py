"""Benchmark: run the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma list). Each query runs to completion into the
``noop`` sink (the whole plan executes, nothing is collected); time is wall
clock per query in seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "tfidf_l2", "term_counts", "bigram_counts", "vocab_ids", "flatten_nested", "json_decode",
    "recent_page", "cursor_page", "review_summary", "title_extract", "title_enrich",
    "dedupe_rows", "drop_seen", "resume_info", "normalize_emoticons", "apply_rules",
    "review_rules", "token_filter", "tag_titles", "lemmatize", "stratified_split",
    "padded_ids", "pool_embeddings", "stream_dedupe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from revspark.plans.catalog import QUERIES
    from revspark.plans.tables import SPREAD_CONF
    from revspark.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.conf.set(SPREAD_CONF, cpus)  # the tables are single files, so single scan tasks
    # warm-up: JVM start, first-job code generation
    spark.range(1000).selectExpr("sum(id)").collect()

    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

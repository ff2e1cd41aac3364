"""Time the headline queries, each run twice in one session.  Prints one JSON line.

``queries`` holds the second run of each, ``first_run`` the first.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from tokenloom.plans import fixtures as fx
from tokenloom.plans.registered import QUERIES
from tokenloom.session import local_session

HEADLINE = [
    "shard_build",
    "batch_xy",
    "batch_rows",
    "batch_schedule",
    "step_lineage",
    "global_offsets",
    "split_spans",
    "tokenize_codepoint",
    "tokenize_bytes",
    "tokenize_bpe",
    "decode_roundtrip",
    "src_chunks",
    "src_text_scan",
    "sink_clean_docs",
    "corpus_union",
    "scan_qa_json",
    "scan_forum",
    "incremental_equals_full",
    "stream_ingest",
    "runlog_steps",
    "runlog_progress",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]

    size = fx.table(spark, sf_dir, "documents").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")).first()
    seconds, first = {}, {}
    for name in names:
        for figures in (first, seconds):  # the second run is past JIT and worker start-up
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            figures[name] = round(time.perf_counter() - started, 3)

    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "first_run": first,
        "sf": (re.findall(r"sf([0-9.]+)", sf_dir) or [sf_dir])[-1],
        "docs": size.docs,
        "tokens": size.chars,
    }
    if "shard_build" in seconds:
        result["shard_build_tokens_per_sec"] = round(size.chars / seconds["shard_build"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()

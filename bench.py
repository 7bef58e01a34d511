"""Headline queries on one machine: prints one JSON line with the seconds of each.

BENCH_SF_DIR: tables (sf0.1 by default); BENCH_CPUS: threads (8).  --dry-run lists the queries; --repeat N keeps the best of N.
"""

from __future__ import annotations

import argparse
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from xylem import corpora
from xylem.engine import Documents
from xylem.queries import QUERIES

NAMES = ["path_child", "path_root", "attr_eq", "child_eq", "index_n", "last_minus", "wellformed_flags", "token_counts_pages", "match_count_by_doc", "doc_stats", "large_doc_path", "match_text_utf8"]
STORED = {"stored_path": "/order/item/qty", "stored_attr": "/order[@status='F']/item/qty", "stored_child": "/order/item[flag=R]/qty", "stored_index": "/order/item[2]/qty"}


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--repeat", type=int, default=1)
    args = parser.parse_args()
    if args.dry_run:
        print(json.dumps([*NAMES, "store_elements", *STORED]))
        return
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as tmp:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.checkpoint.dir", f"{tmp}/checkpoint").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")

        def seconds(run) -> float:
            best = float("inf")
            for _ in range(args.repeat):
                began = time.perf_counter()
                run()
                best = min(best, time.perf_counter() - began)
            return round(best, 3)

        sink = lambda df: df.write.format("noop").mode("overwrite").save()
        sink(QUERIES["path_child"](spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf))  # starts the JVM's code
        took = {n: seconds(lambda n=n: sink(QUERIES[n](spark, sf))) for n in NAMES}
        docs = Documents(corpora.orders_xml(spark, sf), unique_ids=True)
        box = []
        took["store_elements"] = seconds(lambda: box.append(docs.store(f"{tmp}/elements{len(box)}")))
        for name, path in STORED.items():
            took[name] = seconds(lambda path=path: sink(box[-1].xpath(path)))
        spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()

"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from passagemill.catalog import QUERIES
from passagemill.operators import search
from passagemill.plans.session import fresh_path, local_session, steps
from passagemill.sources import stores

HEADLINE = [
    "load_pages",
    "html_page_text",
    "make_chunks",
    "window_chunks",
    "describe_numeric",
    "exact_dedup",
    "build_qrels",
    "embed_text",
    "knn_exact",
    "search_report",
    "maxsim",
    "knn_lsh",
    "inverted_index",
    "bm25_search",
    "hybrid_search",
    "batch_ask",
    "evaluate_dataset",
    "rouge_n",
    "extract_entities",
    "build_edges",
    "connected_components",
    "communities",
    "k_hop",
    "relational_paths",
    "stream_chunks",
]


#: Generated vectors to each stored one for the scan: 50 x 2,000 x 768 at sf0.1, a seventeenth of 1.68 million to spare the disk.
SCAN_COPIES = 50


def scan(spark, folder: str) -> float:
    """Seconds for one query over stored packed vectors; generating and storing them is not timed."""
    with steps(spark):
        table = spark.read.parquet(f"{folder}/embeddings.parquet").repartition(64)
        many = search.random_vectors_like(table, "vec_id", SCAN_COPIES, 768).select(
            (F.col("vec_id") * SCAN_COPIES + F.col("copy")).alias("item_id"), "vec"
        )
        path = fresh_path(spark, "scan")
        stores.write_vectors_parquet(many, path, packed="vec")
        stored = spark.read.parquet(path)
        one = stored.orderBy("item_id").limit(1).withColumnRenamed("item_id", "query_id")
        start = time.perf_counter()
        search.knn_exact(one, stored, 5).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    # one small action starts the JVM's and the Python workers' machinery outside the timings
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    if not os.environ.get("BENCH_QUERIES"):
        times[f"scan_{SCAN_COPIES}_x_table_x_768"] = scan(spark, folder)
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

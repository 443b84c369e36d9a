"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores; query names given
as arguments replace the headline list. Each query is run to the end, with its
whole result written to a sink that drops it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from nearkin.plans.queries import QUERIES

HEADLINE = (
    "clean_and_hash",
    "chunk_words",
    "assemble_parts",
    "extract_pages",
    "new_documents_only",
    "ingest_pages",
    "stream_ingest_pages",
    "hashed_embedding_pooled",
    "cached_embedding",
    "average_pool",
    "vector_table_cosine",
    "knn_cosine",
    "knn_l2",
    "knn_blocks",
    "hit_metadata_default",
    "search_texts",
    "search_files_cosine",
    "average_similarity",
    "universal_report",
    "common_words",
    "word_counts",
    "embedding_stats",
    "similarity_stats",
    "text_stats",
    "pca_2d",
    "similarity_map",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("nearkin-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("short_text_embedding")  # starts the JVM's and Python's workers
    run("whole_text_embedding")
    seconds = {name: run(name) for name in names}
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

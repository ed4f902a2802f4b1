"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma-separated names, or ``all``) choose what runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "count_tokens", "register_documents", "text_to_elements", "markdown_to_elements", "heading_path_stack",
    "mark_page_chrome", "chunk_documents", "build_postings", "fts_search", "vector_search", "hybrid_search",
    "embedding_plan", "extract_metadata_candidates", "promote_metadata", "analysis_batches",
    "understanding_passages", "verify_cards", "duplicate_card_pairs", "dedup_rank_cards", "enrich_cards",
    "remap_by_hash", "page_signals", "paper_status_rollup", "run_states",
]


def split_copy(spark: SparkSession, root: str, parts: int) -> str:
    """The tables again in several files each, so that a scan uses every core as it would on a cluster."""
    target = os.path.join(tempfile.mkdtemp(prefix="bench-"), os.path.basename(root.rstrip("/")))
    for name in sorted(os.listdir(root)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{root}/{name}").repartition(parts).write.parquet(f"{target}/{name}")
    return target


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from leafgrain.plans.catalog import QUERIES
    from leafgrain.plans.registry import configure

    configure(spark)
    root = split_copy(spark, root, int(cpus))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    seconds: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in names:
        began = time.perf_counter()
        # Every row and column is produced and dropped: no pruning by a count.
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(root.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import checks  # noqa: E402
from fairtag.session import local_session, scratch  # noqa: E402

#: The tables that the headline queries read.
TABLES = "customer supplier part orders lineitem events documents pages".split()
HEADLINE = [
    "ing_1_listing_upsert", "ing_2_seen_counters", "ing_3_price_change_log", "txt_2_normalize", "cls_3_most_specific_winner",
    "cls_4_5_6_fuzzy_fallback", "cls_classify", "sta_5_distribution_per_product", "sta_8_mid_rank", "sta_9_histogram",
    "dea_9_top_deals", "dea_10_product_live_view", "cmp_3_basis_p25", "ret_4_current_retail", "src_2_price_param",
    "src_5_jsonld_products", "alr_1_fresh_deals", "agg_2_status",
]


def spread(spark, sf: str, parts: int) -> str:
    """A copy of the tables in several files. The driver writes each as one row group, which a single task would read."""
    folder = f"{scratch(spark)}/bench"
    for table in TABLES:
        rows = spark.read.parquet(f"{sf}/{table}.parquet")
        rows.repartition(parts, rows.columns[0]).write.parquet(f"{folder}/{table}.parquet")
    return folder


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    checks.load_all()
    spark = local_session("fairtag-bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    # Start-up of the JVM and of the Python workers is not part of any query, nor is the splitting of the tables.
    tables = spread(spark, sf, spark.sparkContext.defaultParallelism)
    checks.QUERIES["sta_1_sample_selection"](spark, tables).count()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        checks.QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf).name, "tables": "spread over files of several row groups beforehand",
    }))
    spark.stop()


if __name__ == "__main__":
    main()

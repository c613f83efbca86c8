"""Times headline queries; prints one JSON line."""

import importlib
import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "group_accounting_v11", "span_outcome_lattice", "interval_union", "method_summaries_grouping_sets", "pair_model_cells", "candidate_verdicts",
    "generated_variants", "duplicate_clusters", "band_threshold_sweep", "ece_brier", "nearest_rank_percentiles", "connected_components",
    "twin_accounting", "same_detection_assertions", "near_duplicate_pairs", "negative_class", "twin_edits", "evasion_outcomes", "leaked_fragments", "rekeyed_entries", "row_diagnostics",
    "op1_language_id", "op2_exact_topk", "op3_substring_dedup", "op4_token_orc", "op5_ann", "op6_ngram_join", "op7_pii", "op8_licenses", "op9_mixing", "op10_sentencepiece", "op11_spelling", "op12_filter_audit", "op13_decontamination", "pipeline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {}
    for name in HEADLINE:
        if name in queries:
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

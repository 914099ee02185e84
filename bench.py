"""Times the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from catalog.queries import QUERIES

HEADLINE = [
    "mc_accuracy_strict",
    "mc_accuracy_mean",
    "mc_accuracy_vote",
    "mc_predictions",
    "responses_attached",
    "problem_uuid",
    "fewshot_prompt",
    "augment_invariants",
    "cloze_unroll",
    "cloze_accuracy_ln_un",
    "min_k_auc",
    "roc_auc_events",
    "judge_parse",
    "rounds_until_stop",
    "round_stats",
    "conversation_scores",
    "leaderboard",
    "turn_pairs",
    "opening_messages",
    "transcript_render",
    "validated_filter",
    "resume_pending",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", "32" if cpus == "*" else str(int(cpus)))
        # the tables are a few MB: without this, stages after a shuffle would use one or two cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["mc_accuracy_mean"](spark, sf_dir).collect()  # starts the JVM's code paths
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # the noop sink computes every row and column without moving them to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

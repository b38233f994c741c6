"""Wall-clock of headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.

One query warms the session up; each query then runs once, and, where that took less than AGAIN seconds, twice more: its figure is the median.
"""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from divit.plans.catalogue import QUERIES
from divit.plans.text_engine import QUERIES as TEXT

HEADLINE = ("token_freq", "majority_spelling", "ambiguous_keys", "coverage_rollup", "longest_prefix_root", "context_features", "loo_outcomes", "foreign_islands", "root_vote", "train_minus_test_paragraphs",
            "nearest_owner_6", "phrase_covered_tokens", "learned_suffix_rules")
AGAIN = 12


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "16")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.time()
        (QUERIES | TEXT)[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - start

    timed(HEADLINE[0])
    took = {}
    for name in HEADLINE:
        runs = [timed(name)]
        if runs[0] < AGAIN:
            runs += [timed(name), timed(name)]
        took[name] = round(median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

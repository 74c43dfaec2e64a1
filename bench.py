"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores).
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colloquy import plans
from colloquy.session import build_session

HEADLINE = [
    "i04_pairwise_overlap", "i05_merge_union", "i08_occupancy", "i11_aggregate_turns", "i14_interruptions", "i15_backchannels",
    "i16_speech_metrics", "j05_asof_backward", "j07_interpolate", "j08_interval_overlap_join", "g03_episodes_irregular", "g08_fixations",
    "g09_shared_object", "g16_convergence", "a01_describe_by", "a04_entropy_nats", "a05_gini", "c03_zscore_within", "e03_strategy_coverage",
    "e13_task_table", "k01_match_greedy", "p02_spearman", "p03_correlation_matrix", "p06_bootstrap_ci", "p12_correlation_table",
    "p13_cronbach_alpha", "p20_pca_loadings", "p30_ols_two", "p46_components",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEM", "6g"), "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.local.dir": tempfile.mkdtemp(prefix="spark-"), "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans.load_all()
    plans.QUERIES["i05_merge_union"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

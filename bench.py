"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line. Each time is the median of warm runs: all queries run once before any is timed."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

HEADLINE = (
    "sampling_decisions", "trace_summary", "ready_traces", "policy_results", "rule_decisions", "compressed_groups", "compression_residual",
    "export_rows", "export_batches", "slowest_traces", "error_traces", "service_stats", "sql_window", "sql_join",
)
RUNS = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tracewell.plans import queries as plans
    from tracewell.session import session

    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    every, seconds = plans.queries(), {}
    for name in HEADLINE:
        every[name](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            every[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 3)
    spans = spark.read.parquet(f"{sf}/events.parquet").count()
    spark.stop()
    flagship = seconds["sampling_decisions"]
    print(json.dumps({"metric": "sampling_decisions_seconds", "value": flagship, "unit": "sec", "queries": seconds, "sf": sf, "spans": spans, "spans_per_sec": round(spans / flagship)}))


if __name__ == "__main__":
    main()

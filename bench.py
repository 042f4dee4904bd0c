"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The five shapes of the reference's own rule benchmark (pass, gate, window, json, mixed) run as
batch plans over ``events``; the others are heavier queries of the catalog. Each query runs
once to warm up and is timed on the second run, to a sink that reads all its columns.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SHAPES = {
    "pass": ("value", '(on "events.>" (publish! (subject-append "copy") payload))'),
    "gate": ("value", '(on "events.>" (when (> payload-float 1000000) (publish! (subject-append "high") payload)))'),
    "window": ("value", '(on "events.>" (-> payload-float (moving-avg 10) (publish! (subject-append "avg"))))'),
    "json": ("props", '(on "events.>" (-> payload (json-get "k") (publish! (subject-append "k"))))'),
    "mixed": ("value", '(on "events.>" (-> payload-float (round 1) (squelch) (publish! (subject-append "stable")))) (on "events.>" (-> payload-float (deadband 5) (publish! (subject-append "delta"))))'),
}
CATALOG = ["flagship_stable", "moving_avg_time", "percentile", "bar_ticks", "bar_time", "debounce", "sample", "aggregate_avg", "hysteresis", "transition", "last", "funnel", "demux_then_delta"]


def main() -> None:
    from tidegate import engine, session, sources
    from tidegate.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.local(cpus, int(cpus) if cpus.isdigit() else 8, "8g", **{"spark.ui.showConsoleProgress": "false"})
    todo = {f"shape_{k}": lambda p=p, r=r: engine.run(r, sources.events(spark, sf_dir, p)) for k, (p, r) in SHAPES.items()}
    found = catalog.queries()
    todo |= {k: lambda k=k: found[k](spark, sf_dir) for k in CATALOG}
    took = {}
    for name, make in todo.items():
        for _ in range(2):
            t = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - t, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {k: round(rows / took[f"shape_{k}"]) for k in SHAPES}
    print(json.dumps({"metric": "sum of query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "rows": rows, "rows_per_s": rates, "cpus": cpus}))


if __name__ == "__main__":
    main()

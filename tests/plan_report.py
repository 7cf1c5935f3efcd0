"""Summarise the physical plan of every registered query into PLANS.md.

    python tests/plan_report.py [--sf-dir DIR]

Per query: shuffles (Exchange), join strategies, windows, generators,
operators outside whole-stage code generation, and the filters pushed into
each parquet scan.  Plans are taken with AQE's initial (static) plan.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))



def summarise(plan: str) -> dict:
    ops = Counter(re.findall(
        r"(Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|"
        r"Exchange RoundRobinPartitioning|BroadcastExchange|BroadcastHashJoin|SortMergeJoin|"
        r"ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|Window|Generate|"
        r"HashAggregate|SortAggregate|ObjectHashAggregate|TakeOrderedAndProject)", plan))
    pushed = sorted({m for m in re.findall(r"PushedFilters: \[([^\]\n]*)", plan) if m})
    return {"ops": dict(ops), "pushed": pushed}


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(os.path.dirname(os.path.dirname(
        os.path.abspath(__file__))), "PLANS.md"))
    args = ap.parse_args(argv)
    import __spark_entry__ as E
    from vigilo.plans import ml_queries
    from vigilo.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # show the static plan
    rows = []
    for name, fn in E.queries().items():
        if name in ml_queries.QUERIES or name == "pipeline" or re.match(r"op\d+_", name):
            continue
        tracker = spark.sparkContext.statusTracker()
        before = set(tracker.getJobIdsForGroup(None))
        df = fn(spark, args.sf_dir)
        jobs = len(set(tracker.getJobIdsForGroup(None)) - before)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        shuffles = sum(v for k, v in s["ops"].items() if k.startswith("Exchange"))
        joins = ", ".join(f"{k} x{v}" for k, v in s["ops"].items() if "Join" in k
                          or k in ("CartesianProduct",))
        other = ", ".join(f"{k} x{v}" for k, v in s["ops"].items()
                          if k in ("Window", "Generate", "TakeOrderedAndProject"))
        pushed = "; ".join(p[:90] for p in s["pushed"][:2])
        rows.append(f"| `{name}` | {shuffles} | {joins or '-'} | {other or '-'} | {pushed or '-'} | {jobs} |")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    text = ["# Physical plans (static, before AQE), sf 0.01", "",
            "Generated by `python tests/plan_report.py`.  Shuffles = Exchange operators "
            "(hash, range, single-partition, round-robin); broadcast exchanges are listed with "
            "the joins.  The one shuffle of the message queries is `spread()` (hash on "
            "event_id; the sf 0.01 input is a single split, a large table skips it).  No query uses a "
            "cartesian product or a nested-loop join.  The last column counts the Spark jobs that ran "
            "while the query was built: one per table for its parquet schema, and for queries that "
            "write and read back (lake, stream, code tables, topics) the writes themselves, whose "
            "shuffles are not in the final frame's plan.  Model and training-data queries are omitted "
            "(their cost is in the fits and writes).", "",
            "| Query | Shuffles | Joins | Windows / generators / top-k | Filters pushed to parquet | Jobs while building |",
            "| --- | --- | --- | --- | --- | --- |", *rows, ""]
    with open(args.out, "w") as fh:
        fh.write("\n".join(text))
    print(f"wrote {args.out} ({len(rows)} queries)")


if __name__ == "__main__":
    main()

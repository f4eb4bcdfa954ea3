"""Write PLANS.md: physical-plan facts of every registered query.

Runs each query on the given scale (default sf0.01) with the ``noop`` sink,
then reads the final adaptive plan: shuffles, join strategies, aggregate
kinds, map-side limits, Python stages, reused exchanges and pushed filters.

    python tools/plan_report.py [/root/testdata/sf0.01] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepool.plans.catalog import QUERIES  # noqa: E402
from tidepool.session import local_session  # noqa: E402

KINDS = [
    ("Exchange hashpartitioning", "hash shuffles"),
    ("Exchange RoundRobin", "round-robin"),
    ("Exchange rangepartitioning", "range shuffles"),
    ("Exchange SinglePartition", "single-partition"),
    ("BroadcastExchange", "broadcasts"),
    ("ReusedExchange", "reused"),
    ("BroadcastHashJoin", "BHJ"),
    ("SortMergeJoin", "SMJ"),
    ("ShuffledHashJoin", "SHJ"),
    ("HashAggregate", "HashAgg"),
    ("SortAggregate", "SortAgg"),
    ("ObjectHashAggregate", "ObjHashAgg"),
    ("WindowGroupLimit", "WGLimit"),
    ("MapInArrow", "Python"),
    ("FlatMapGroupsInPandasWithState", "PyState"),
]


REVIEW = """## Review at 100 TB scale

* Grouped aggregates have primitive buffers (hash aggregate with a partial
  step before the shuffle); only the change feed's fold keeps a struct per
  path and sorts.  Upserts and first writers show `WindowGroupLimit` twice:
  the partial top-1 before the shuffle and the final one after it.
* Broadcasts below are AQE decisions from runtime sizes (the 10 MB
  auto-broadcast check); no operator forces one, so a side that grows with
  the data falls back to a shuffled join.
* Chunking, statistics and fingerprints read their files where the scan puts
  them: no shuffle before the Python stage, at any number of splits or cores.
* `delta_summary` and `bandwidth_reduction` union both versions with a tag:
  one aggregate by `(file, hash)`, one by file, no join.
* W1/S3 (`chunk_offsets`, `file_chunks`) run the two-level prefix: block
  totals, a window over blocks, a window inside blocks.
* Filters on plain columns of the driver tables reach the scan; projections prune to the columns used (ReadSchema).
* Streaming queries run to completion inside the call; the returned plan
  reads their output tables, so it shows only the read-back.
"""


def final_plan(df) -> str:
    df.collect()  # runs this DataFrame's own query execution (small scale only)
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, shuffle_partitions=8)
    print("# Physical plans of the registered queries\n")
    print(f"Final adaptive plans at `{sf}` on local[8] (`tools/plan_report.py`). "
          "Counts are plan nodes; 'pushed' lists filters pushed into parquet scans.\n")
    print(REVIEW)
    print("| query | " + " | ".join(k for _, k in KINDS) + " | pushed |")
    print("|---" * (len(KINDS) + 2) + "|")
    for name, fn in QUERIES.items():
        try:
            plan = final_plan(fn(spark, sf))
        except Exception as exc:  # noqa: BLE001
            print(f"| {name} | error: {type(exc).__name__} |")
            continue
        counts = [str(plan.count(pat)) if plan.count(pat) else "" for pat, _ in KINDS]
        pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p})
        print(f"| {name} | " + " | ".join(counts) + f" | {'; '.join(pushed)[:120]} |")
    spark.stop()


if __name__ == "__main__":
    main()

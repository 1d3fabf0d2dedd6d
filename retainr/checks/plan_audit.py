"""Physical-plan audit of every registered analysis.

    python -m retainr.checks.plan_audit [sf_dir]

Prints a Markdown table: hash / range exchanges, broadcast exchanges, join strategies,
``Exchange SinglePartition`` nodes that are not the final merge of a global aggregate,
nested-loop or cartesian joins, and whether the delivered-status filter reached a Parquet scan.
"""

from __future__ import annotations

import re
import sys


def audit(plan: str) -> dict:
    lines = plan.splitlines()
    single = 0
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            if not ("HashAggregate(keys=[]" in child and "partial_" in child):
                single += 1
    joins = sorted(set(re.findall(
        r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)",
        plan)))
    return {
        "hash_ex": sum("Exchange hashpartitioning" in x for x in lines),
        "range_ex": sum("Exchange rangepartitioning" in x for x in lines),
        "bcast": sum("BroadcastExchange" in x for x in lines),
        "joins": ", ".join(joins) or "-",
        "single": single,
        "nested": int("BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan),
        "pushed": int("EqualTo(order_status,delivered)" in plan),
        "python": int(any(n in plan for n in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF"))),
    }


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from retainr.plans.registry import QUERIES
    from retainr.session import get_spark
    from retainr.sources.mapping import canonical_tables

    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    print("| query | hash exch. | range exch. | broadcast | joins | unbounded single-partition "
          "| nested loop | status filter in scan | Python UDF |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        a = audit(fn(canonical_tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | {a['hash_ex']} | {a['range_ex']} | {a['bcast']} | {a['joins']} | "
              f"{a['single']} | {a['nested']} | {'yes' if a['pushed'] else '-'} | "
              f"{'YES' if a['python'] else 'no'} |")
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

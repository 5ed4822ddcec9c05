"""Write PLANS.md: for every registered query, the exchanges, broadcasts,
joins and windows of its physical plan (sf0.01, final adaptive plan).

usage: python tools/plan_report.py [--sf /root/testdata/sf0.01] [--out PLANS.md]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _balanced(text: str, start: int) -> str:
    """Text inside the parenthesis opening at ``start``."""
    depth = 0
    for i in range(start, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return text[start + 1 : i]
    return text[start + 1 :]


def _split_top(args: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in args:
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]


def summarize(plan: str) -> dict[str, str]:
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    exchanges = []
    for m in re.finditer(r"Exchange (hashpartitioning|rangepartitioning)\(", plan):
        inner = _balanced(plan, m.end() - 1)
        origin = re.match(r", (\w+)", plan[m.end() + len(inner) + 1 :])
        keys = _split_top(inner)[:-1]  # the last argument is the partition count
        keys = ", ".join(re.sub(r"#\d+L?", "", k).replace(" ASC NULLS FIRST", "").strip() for k in keys)
        kind = "hash" if m.group(1).startswith("hash") else "range"
        exchanges.append(f"{kind}({keys}) {origin.group(1).lower() if origin else ''}".strip())
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", plan)
    return {
        "exchanges": "; ".join(exchanges) or "-",
        "broadcasts": str(plan.count("BroadcastExchange")),
        "joins": ", ".join(f"{j} x{joins.count(j)}" for j in sorted(set(joins))) or "-",
        "windows": str(len(re.findall(r"\bWindow \[", plan))),
        "python": "yes" if re.search(r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas)", plan) else "no",
    }


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default="PLANS.md")
    args = ap.parse_args()
    from catchment.session import local_session
    from catchment import queries as Q

    spark = local_session(8)
    lines = [
        "# Physical plans of the registered queries",
        "",
        f"Generated by `tools/plan_report.py` on `{args.sf}` ({spark.conf.get('spark.sql.shuffle.partitions')} "
        "shuffle partitions), from the final adaptive plan of each executed query. The exchange keys are those of the shuffle; its origin "
        "is `repartition_by_num` for an explicit layout (never coalesced) or `ensure_requirements` where an "
        "operator asked for it. Materialized stages (checkpoints) appear as scans of the checkpoint, so the plan "
        "after them is listed.",
        "",
        "| Query | Exchanges (keys, origin) | Broadcasts | Joins | Windows | Python |",
        "| --- | --- | --- | --- | --- | --- |",
    ]
    for name, fn in dict(Q.QUERIES).items():
        df = fn(spark, args.sf)
        df.collect()  # run it, so the adaptive plan is final
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        lines.append(f"| `{name}` | {s['exchanges']} | {s['broadcasts']} | {s['joins']} | {s['windows']} | {s['python']} |")
    with open(args.out, "w") as f:
        f.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()

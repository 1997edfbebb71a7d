"""Print the executed physical plan of registered queries as an operator
skeleton (node names, exchanges, joins, scans with their read schema),
without the long expressions.

usage: python scripts/plan_summary.py <sf_dir> [<query> ...]  > PLANS.md
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimtext.plans import catalog  # noqa: E402
from claimtext.session import get_spark  # noqa: E402

KEEP = re.compile(r"^([ :|+\-]*)(?:\*\(\d+\) )?([A-Z]\w+)(.*)$")


def skeleton(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        if "Plan ==" in line:
            out.append(line.rstrip())
            continue
        m = KEEP.match(line)
        if not m:
            continue
        indent, node, rest = m.groups()
        if node in ("Exchange", "BroadcastExchange"):
            rest = re.sub(r"\[plan_id=\d+\]", "", rest)
            detail = rest.strip()[:70]
        elif node.endswith("Join"):
            detail = " ".join(t for t in rest.split(",") if t.strip() in
                              ("Inner", "LeftOuter", "LeftSemi", "LeftAnti", "BuildLeft", "BuildRight"))
        elif node == "FileScan":
            fm = re.search(r"Location: \w+\(\d+ paths\)\[file:[^\]]*/([\w.]+)\]", rest)
            rs = re.search(r"ReadSchema: (struct<[^>]*>)", rest)
            detail = f"{fm.group(1) if fm else ''} {rs.group(1) if rs else ''}"
        elif node in ("WindowGroupLimit",):
            detail = "Partial" if "Partial" in rest else "Final"
        else:
            detail = ""
        out.append(f"{indent}{node} {detail}".rstrip())
    return out


def main():
    sf = sys.argv[1]
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = get_spark(scan_partitions=16, shuffle_partitions=16)
    print(f"# Executed physical plans ({sf}, local[8], text tables spread over 16 partitions)\n")
    print("Generated by `scripts/plan_summary.py`; expressions omitted.  `AQEShuffleRead` and")
    print("`ShuffleQueryStage` are AQE's runtime nodes; `BroadcastHashJoin` shows AQE's size-checked choice.\n")
    for name in names:
        df = catalog.QUERIES[name](spark, sf)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()                      # run this plan so AQE fixes its final form
        plan = qe.executedPlan().toString()
        print(f"## {name}\n\n```")
        print("\n".join(skeleton(plan)))
        print("```\n")


if __name__ == "__main__":
    main()

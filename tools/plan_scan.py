"""List plan shapes that do not scale: cross joins, unpartitioned windows, row-at-a-time Python, missing column pruning.

usage: python tools/plan_scan.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pixelloom.session import local_session  # noqa: E402
from workload.registry import QUERIES  # noqa: E402

SHAPES = {"cross join": r"BroadcastNestedLoopJoin|CartesianProduct", "row Python": r"BatchEvalPython",
          "single partition": r"Exchange SinglePartition"}


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("plans")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # show what happens when nothing is small
    for name in args.names or QUERIES:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            QUERIES[name](spark, args.sf).explain("simple")
        plan = text.getvalue()
        found = [f"{shape} x{len(re.findall(p, plan))}" for shape, p in SHAPES.items() if re.search(p, plan)]
        print(f"{name}: {len(re.findall('Exchange hashpartitioning', plan))} shuffles, {len(re.findall('FileScan', plan))} scans"
              + ("; " + ", ".join(found) if found else ""), flush=True)


if __name__ == "__main__":
    main()

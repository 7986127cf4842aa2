"""Summarise the physical plan of every registered query (writes PLANS.md).

usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarise(text: str) -> dict:
    sections = re.findall(r"^\((\d+)\) ([A-Za-z]+(?: [A-Za-z]+)?)[^\n]*\n(.*?)(?=\n\(\d+\) |\Z)", text, re.M | re.S)
    names = [name.strip() for _, name, _ in sections]
    args = [body for _, name, body in sections if name.strip() == "Exchange"]

    def kind(body: str) -> str:
        m = re.search(r"Arguments: (\w+)", body)
        return m.group(1) if m else ""

    kinds = [kind(b) for b in args]
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", text)
    return {
        "hash": kinds.count("hashpartitioning"), "range": kinds.count("rangepartitioning"),
        "single": kinds.count("SinglePartition"),
        "broadcast": names.count("BroadcastExchange"),
        "smj": names.count("SortMergeJoin"), "bhj": names.count("BroadcastHashJoin"),
        "window": names.count("Window"), "generate": names.count("Generate"),
        "cols": max((len(s.split(",")) for s in schemas), default=0),
        "pushed": any(p.strip() for p in pushed),
        "checkpointed": "ExistingRDD" in text or "LogicalRDD" in text,
    }


def main() -> None:
    from fieldpulse.plans.catalog import QUERIES
    from fieldpulse.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    rows = []
    for name, q in QUERIES.items():
        s = summarise(plan_text(q(spark, sf)))
        rows.append((name, s))
    lines = [
        "# Physical plans of the registered queries",
        "",
        f"Generated by `tools/plan_report.py` from `explain(\"formatted\")` at {os.path.basename(sf)} "
        "(initial AQE plan; AQE may still turn a sort-merge join into a broadcast at run time).",
        "Columns: hash / range / single = shuffle exchanges by kind; bcast = broadcast exchanges; "
        "SMJ / BHJ = join kinds; window = window operators; cols = widest parquet ReadSchema (events has 6); "
        "pushed = filters pushed into the scan; ckpt = reads a reliable checkpoint (distributed ordinal).",
        "",
        "| query | hash | range | single | bcast | SMJ | BHJ | window | cols | pushed | ckpt |",
        "|---|---|---|---|---|---|---|---|---|---|---|",
    ]
    for name, s in rows:
        lines.append(f"| {name} | {s['hash']} | {s['range']} | {s['single']} | {s['broadcast']} | {s['smj']} | "
                     f"{s['bhj']} | {s['window']} | {s['cols']} | {'yes' if s['pushed'] else ''} | "
                     f"{'yes' if s['checkpointed'] else ''} |")
    lines += [
        "",
        "Reading the table:",
        "",
        "- `window` appears only in queries that use the distributed ordinal (`ckpt`); those windows run over",
        "  the block table (one row per range partition and group), never over the data rows.",
        "- `single` exchanges carry either those block tables or the partial results of a global aggregate",
        "  (one row per task), never raw rows.",
        "- `bcast` is the per-partition block table (bounded by the partition count) or a side that AQE sized",
        "  below the broadcast threshold at run time.",
        "- One `hash` exchange in the JSON message queries is the parallelism floor for a one-row-group input;",
        "  it is not added when the input is as wide as the cluster.",
        "- `cols` shows column pruning: no query reads more of the 6 `events` columns than it uses (the",
        "  streaming and scratch-file queries show the width of the files they read back).",
    ]
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()

"""Run jobs beside their SQL on the same parquet tables and compare the results.

    python tests/compare.py [--sf 0.01] [job ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v if isinstance(v, str) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), round(x, 3) if isinstance(x, float) else x, x) for x in r))


def difference(spark_df, con, sql: str) -> tuple[str, int]:
    """('' when equal, number of rows)."""
    got = spark_df.collect()
    names = spark_df.columns
    rel = con.execute(sql)
    want_names = [c[0] for c in rel.description]
    kinds = {c[0]: str(c[1]) for c in rel.description}
    want = rel.fetchall()
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}", len(got)
    odd = [n for n, k in kinds.items() if "DECIMAL" in k or "HUGEINT" in k or k == "NUMBER"]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    a, b = rows(names, got), rows(want_names, want)
    if a == b:
        return "", len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    close = all(
        all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-9 * max(1, abs(p))) for p, q in zip(x, y))
        for x, y in bad
    )
    x, y = bad[0]
    note = "last bits differ" if close else f"{len(bad)} rows differ"
    return f"{note}: {sorted(names)} {str(x)[:400]} | {str(y)[:400]} {odd}", len(got)


def main() -> int:
    from plumbline.plans import REGISTRY
    from plumbline.session import build_session

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("jobs", nargs="*")
    a = p.parse_args()
    folder = f"/root/testdata/sf{a.sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in a.jobs or REGISTRY:
        job = REGISTRY[name]
        start = time.time()
        try:
            df = job.run(spark, folder)
            if job.sql:
                problem, n = difference(df, con, job.sql)
            else:
                problem, n = "", df.count()
        except Exception as exc:  # report and go on with the next job
            problem, n = "".join(traceback.format_exception_only(exc))[:1500], -1
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {n:8d} rows {time.time() - start:6.1f}s {'' if job.sql else '(no sql)'} {problem}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

"""Exact groups against plain Python."""

import hashlib
import random

from plumbline.llm import exact
from plumbline.llm.queries import op8_exact_copies


def brute(rows):
    same = {}
    for i, t in rows:
        same.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = same[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in exact.exact_groups(df).collect()), key=str)


def test_texts_that_part_late(spark):
    """Groups split at every level: copies, prefixes of each other, and texts that part behind thousands of bytes."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        size = rng.choice([0, 3, 63, 64, 65, 1023, 1024, 1025, 20_000])
        rows.append((i, "é" * (size // 4) + "x" * (size % 4) + rng.choice(["", "a", "b"])))
    rows += [(200 + i, f"{i // 2:04d}" + "p" * 5000) for i in range(40)] + [(300 + i, "p" * 5000 + f"{i // 2:04d}") for i in range(40)]
    rows += [(500 + i, "hot " * 600) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, ""), (None, "a"), (None, "a"), (3, "b"), (3, "b"), (4, "c"), (5, " c")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == brute(rows[:1])
    assert exact.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, "t", 2, 3), (2, "t", 4, 5)], "doc_id long, text string, keep_id int, _group int")
    assert sorted(r.keep_id for r in exact.exact_groups(clash).collect()) == [2, 2]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op8_exact_copies(spark, folder).collect()), key=str) == brute(rows)

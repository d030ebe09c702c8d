"""Ranked search against every score computed in plain Python."""

import math
import re
from collections import Counter

import pytest

from plumbline.llm import ranking
from plumbline.llm.queries import op13_ranked_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    """(item_id, rank, doc_id, score) rows, sorted."""
    found = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in found:
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (100 - 50 + 50 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, row[3], -row[0]) for r, row in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranking.rank_documents(d, i, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"item_bytes": 300}])
def test_whole_tables(spark, options):
    folder = "/root/testdata/sf0.001"
    read = lambda t, c: [(r[c], r.text) for r in spark.read.parquet(f"{folder}/{t}.parquet").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    d, i = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in ranking.rank_documents(d, i, **options).collect()), key=str)
    assert got == brute(docs, items, options.get("k", 50))
    if not options:
        assert sorted((tuple(r) for r in op13_ranked_documents(spark, folder).collect()), key=str) == got


def test_small_slices_and_a_frequent_term(spark, monkeypatch):
    """Many slices per partition, so that thresholds carry over; one term in nearly all documents."""
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(["all"] * rng.randint(0, 3) + rng.choices(words, k=rng.randint(0, 30)))) for i in range(400)]
    items = [(i, " ".join(["ALL"] + rng.choices(words + ["unknown"], k=6))) for i in range(20)]
    monkeypatch.setattr(ranking, "INDEX_BYTES", 1000)
    assert run(spark, docs, items, k=7) == brute(docs, items, 7)


def test_odd_rows(spark):
    docs = [(1, "Ab ab; C3PO"), (None, "ab c3po"), (None, "ab c3po"), (2, "ab c3po"), (2, "ab c3po"), (5, None), (6, ""), (7, "ÄB äb Ωmega x_y"), (8, "...")]
    items = [(1, "AB"), (1, "AB"), (None, "c3po, C3PO"), (3, None), (4, "... !"), (5, "äb"), (6, "X Y"), (7, "nothing here")]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert {r[0] for r in got} == {1, None, 5, 6}


def test_ties_go_by_id(spark):
    docs = [(i, "same words") for i in range(90, 0, -1)] + [(200 + i, "other") for i in range(120)]
    got = ranking.rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, "same")], "item_id long, text string")
    ).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 51)) and len({r.score for r in got}) == 1


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 2, 3, 4)], "doc_id long, text string, rank int, score int, _item int")
    items = spark.createDataFrame([(1, "b", 2, 5)], "item_id long, text string, doc_id int, _block int")
    assert [(r.item_id, r["rank"], r.doc_id) for r in ranking.rank_documents(docs, items).collect()] in ([(1, 1, 1)], [])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0))):
        out = ranking.rank_documents(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0

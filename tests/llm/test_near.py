"""Near duplicates and components, against brute force."""

import numpy as np
import pytest

from plumbline.llm import near
from plumbline.llm.common import table
from plumbline.llm.components import components


def sets_of(text, size=5):
    words = (text or "").encode().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def closed(keys, pairs):
    up = {k: k for k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {k: top(k) for k in keys}


def brute(rows, similarity=0.8):
    sets = [(k, sets_of(t)) for k, t in rows]
    pairs = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                both = len(x & y)
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    pairs.append((a, b))
    return closed([k for k, _ in rows], pairs)


def test_classes_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("tile", [40, 2000])
def test_group_of_varied_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(near, "TILE", tile)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for j in rng.choice(120, 1 + i % 5, replace=False):
            words[j] = f"x{i}.{j}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(i, " ".join(rng.choice(base, 60))) for i in range(40)]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "a b", 1), (4, "a  b", 1), (5, "a b c", 2), (6, "x " * 30000, 1), (7, "x " * 5, 1), (8, "q w e r t y", 3), (8, "q w e r t y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((r.doc_id, r.class_id, r.class_size, r.kept) for r in near.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 2, 1, True), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (6, 6, 2, True), (7, 6, 2, False), (8, 8, 2, True), (8, 8, 2, True)]
    assert near.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_agree_as_often_as_sets_are_similar(weighted):
    rng = np.random.default_rng(1)
    a, b = np.arange(1, 401, dtype=np.uint64), np.arange(101, 501, dtype=np.uint64)
    wa, wb = (rng.uniform(0.2, 4, 501) for _ in range(2)) if weighted else (np.ones(501), np.ones(501))
    x, y = np.zeros(501), np.zeros(501)
    x[1:401], y[101:501] = wa[1:401], wb[101:501]
    expected = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    first = np.array([0, 400, 800])
    out = near.dart_signatures(near.W.mix(np.concatenate((a, b))), np.concatenate((x[1:401], y[101:501])), first, 4000)
    assert (out != 0).all()
    assert abs((out[0] == out[1]).mean() - expected) < 4 * np.sqrt(expected * (1 - expected) / 4000)


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(60) if i != 30] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    edges += [tuple(int(v) for v in rng.integers(300, 400, 2)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.v: r.comp for r in components(df).collect()}
    expected = closed({v for e in edges for v in e}, edges)
    lone = {v for v in expected if all(a == b for a, b in edges if v in (a, b))}
    assert got == {v: c for v, c in expected.items() if v not in lone}

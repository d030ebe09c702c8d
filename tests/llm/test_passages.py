"""Repeated passages and benchmark leaks, against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, substrings
from plumbline.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def brute_repeats(rows, window=13):
    first = {}
    for key, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            seq = tuple(words[i : i + window])
            first[seq] = min(first.get(seq, key), key)
    out = []
    for key, text in rows:
        words = (text or "").encode().split()
        drop = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < key:
                drop[i : i + window] = [True] * window
        out.append((key, len(words), sum(drop), b" ".join(w for w, d in zip(words, drop) if not d).decode()))
    return sorted(out)


def run_repeats(df):
    got = substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", "text")
    return sorted(tuple(r) for r in got.collect())


def test_repeats_on_documents(spark):
    docs = table(spark, FOLDER, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run_repeats(docs) == brute_repeats(rows)


def test_repeats_at_every_offset_and_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(i, " ".join(f"w{i}.{j}" for j in range(i)) + f" {passage}\n\ttail{i}") for i in range(15)]
    rows += [(100, None), (101, ""), (102, "short text"), (103, passage + " " + passage), (103, passage), (104, "é x " + passage)]
    rows += [(200, " ".join(["the"] * 40)), (201, "a " + " ".join(["the"] * 15)), (1, " ".join(["the"] * 13))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("hashes", F.lit(1))
    assert run_repeats(df) == brute_repeats(rows)


def test_repeats_of_empty_table(spark):
    assert run_repeats(spark.createDataFrame([], "doc_id long, text string")) == []


def contains(text, item):
    norm = lambda s: " " + " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", s.lower())) + " "
    return norm(item) in norm(text)


@pytest.mark.parametrize("per_index", [7, 20_000])
def test_leaks_on_documents(spark, monkeypatch, per_index):
    monkeypatch.setattr(decontaminate, "ITEMS_PER_INDEX", per_index)
    docs, items = table(spark, FOLDER, "documents"), table(spark, FOLDER, "benchmark")
    held = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if contains(d.text or "", i.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert held and got == held
    left = decontaminate.drop_leaks(docs, items)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in held}


def test_bounds_drop_no_passage_above_the_threshold(spark):
    """Every pair whose full score reaches the threshold is found, whatever block bounds prune."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(50)]
    texts = []
    for i in range(200):
        words = items[i % 50][1].split()
        for j in rng.choice(12, rng.integers(0, 7), replace=False):
            words[j] = str(rng.choice(vocabulary))
        texts.append(" ".join(rng.choice(vocabulary, rng.integers(0, 30))) + " " + " ".join(words))
    df = spark.createDataFrame(items, "item_id long, text string")
    (index,) = decontaminate.indexes(df, "item_id", "text", 0.6)
    got = decontaminate.search(index, pa.array(texts), 0.6, 0.0)
    word = {w: decontaminate._split(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0] for w in vocabulary}
    expected = set()
    for row, text in enumerate(texts):
        words = text.split()
        for begin in range(0, max(1, len(words)), index.span):
            held = {word[w] for w in words[begin : begin + 2 * index.span]}
            scores = np.zeros(50)
            for t, term in enumerate(index.terms):
                if term in held:
                    at = slice(index.first[t], index.first[t + 1])
                    scores[index.items[at]] += index.impacts[at]
            expected |= {(row, int(i)) for i in np.flatnonzero(scores >= 0.6)}
    assert set(got) == expected and len(expected) >= 150


def test_leaks_of_odd_rows(spark):
    item = "Which of these words belongs here?\nThe last one of all"
    docs = spark.createDataFrame(
        [(1, None, 0.5), (2, "", 0.5), (3, "x " * 5000 + item.upper() + " y" * 5000, 0.5), (3, item, 0.1), (None, item, 0.2), (5, item[:30], 0.1)],
        "doc_id long, text string, score double",
    )
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == [(0, 7), (3, 7), (3, 7)]
    assert decontaminate.drop_leaks(docs, items).count() == 3
    empty = items.limit(0)
    assert decontaminate.find_leaks(docs, empty).count() == 0
    assert decontaminate.drop_leaks(docs, empty).count() == 6
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0

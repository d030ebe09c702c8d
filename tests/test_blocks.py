"""Sparse top-k search in blocks, and the dictionary's head and tail, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import retrieval as R


def terms(text):
    words = [w for w in text.split() if len(w) > 1]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def brute(kb, texts, k):
    counted = {i: terms(t) for i, t in kb}
    df = Counter(t for c in counted.values() for t in c)
    idf = {t: math.log((1 + len(kb)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / norm for t, x in w.items()}

    passages = {i: unit(c) for i, c in counted.items()}
    out = []
    for key, text in texts:
        q = unit(terms(text))
        sims = sorted((-round(sum(x * p.get(t, 0.0) for t, x in q.items()), 9), i) for i, p in passages.items())
        out += [(key, i, -s, r) for r, (s, i) in enumerate(sims[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    line = lambda n: " ".join(["all"] * (rng.random() < 0.9) + [words[min(int(rng.expovariate(0.02)), 299)] for _ in range(n)])
    kb = [(i, line(rng.randint(0, 12))) for i in range(150)]
    texts = [(i, line(rng.randint(0, 8))) for i in range(80)] + [(100 + i, "all all") for i in range(60)] + [(500, ""), (501, "zz yy"), (502, kb[7][1])]
    return kb, texts


@pytest.mark.parametrize("passages, local", [(4, 0), (50, 0), (2048, 0), (2048, R.LOCAL_POSTINGS)])
def test_hits_against_brute_force(spark, corpus, passages, local):
    kb, texts = corpus
    index = R.build_index(spark.createDataFrame(kb, "kb_id long, content string"), "kb_id", "content", stop_words=[], block_passages=passages)
    df = spark.createDataFrame(texts, "i long, t string")
    got = sorted((r.i, r.kb_id, round(r.sim, 9), r["rank"]) for r in R.sparse_hits(df, ["i"], "t", index, stop_words=[], local_postings=local).collect())
    want = brute(kb, texts, 3)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_bounds_leave_blocks_unread(spark, monkeypatch):
    """Texts that share telling terms with one passage, and a frequent one with all, meet a single block."""
    asked, probe = [], R._probe
    monkeypatch.setattr(R, "_probe", lambda index, df, *a, **b: asked.append(df.count()) or probe(index, df, *a, **b))
    kb = spark.createDataFrame([(i, "all " + " ".join(f"own{i}x{j}" for j in range(6))) for i in range(150)], "kb_id long, content string")
    index = R.build_index(kb, "kb_id", "content", stop_words=[], block_passages=4)
    hits = R.sparse_hits(kb.withColumnRenamed("kb_id", "i"), ["i"], "content", index, k=1, stop_words=[], local_postings=0).collect()
    assert all(r.i == r.kb_id for r in hits) and len(hits) == 150
    assert asked == [150, 0]


@pytest.mark.parametrize("group, groups", [(2048, 1), (16, 10)])
def test_a_text_goes_once_to_a_group_of_blocks(spark, corpus, monkeypatch, group, groups):
    """However many small blocks bounds leave open, a text and its vector are sent to a task once per group."""
    asked, probe = [], R._probe
    monkeypatch.setattr(R, "_probe", lambda index, df, *a, **b: asked.append(df.collect()) or probe(index, df, *a, **b))
    monkeypatch.setattr(R, "BLOCK_PASSAGES", group)
    kb, texts = corpus
    index = R.build_index(spark.createDataFrame(kb, "kb_id long, content string"), "kb_id", "content", stop_words=[], block_passages=4)
    assert index.postings.select("group").distinct().count() == groups
    hits = R.sparse_hits(spark.createDataFrame(texts, "i long, t string"), ["i"], "t", index, stop_words=[], local_postings=0).collect()
    want = brute(kb, texts, 3)
    assert sorted((r.i, r.kb_id, r["rank"]) for r in hits) == [w[:2] + w[3:] for w in want]
    sent = [(r.key.i, r.group) for rows in asked for r in rows]
    assert len(sent) == len(set(sent)) and (len(asked[1]) == 0) == (groups == 1)


def test_blocks_below_the_bound_stay_unread():
    """Of a group's posting lists those are found by term and block, and summed alone."""
    term, kb_id, block = ["a", "a", "a", "b", "b"], [1, 4, 7, 4, 9], [0, 0, 2, 0, 5]
    held = R._Group(pa.array(term), pa.array(kb_id), np.arange(1.0, 6.0), np.array(block))
    lists, of = held.lists(np.array([1, 0]))
    assert [(int(o), int(held.blocks[held.block[i]]), float(held.most[i])) for i, o in zip(lists, of)] == [(0, 0, 4.0), (0, 5, 5.0), (1, 0, 2.0), (1, 2, 3.0)]
    assert held.sums(np.array([0, 1]), lists[[0, 3]], np.array([10.0, 100.0]), 2).tolist() == [[0.0, 40.0, 0.0, 0.0], [0.0, 0.0, 300.0, 0.0]]


def test_head_and_tail_of_the_dictionary(spark, corpus):
    kb, texts = corpus
    index = R.build_index(spark.createDataFrame(kb, "kb_id long, content string"), "kb_id", "content", stop_words=[])
    df = spark.createDataFrame(texts, "i long, t string")
    got = [sorted((r.i, r.term, round(r.w, 9)) for r in R.weigh(df, ["i"], "t", index, [], head_terms=n).collect()) for n in (100_000, 20)]
    assert got[0] == got[1] and len(got[0]) > 300


def test_no_vocabulary_cut_by_default(spark):
    kb = spark.range(30).select(F.col("id").alias("kb_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("t"), (F.col("id") * 1000 + i).cast("string")))).alias("content"))
    assert R.build_index(kb, "kb_id", "content").vocabulary.count() == 30 * (200 + 199)
    assert R.build_index(kb, "kb_id", "content", max_terms=4096).vocabulary.count() == 4096


def test_text_ids_and_empty_tables(spark):
    kb = spark.createDataFrame([("b", "water boils"), ("a", "iron rusts"), ("c", None)], "kb_id string, content string")
    index = R.build_index(kb, "kb_id", "content")
    df = spark.createDataFrame([(1, "iron"), (2, None)], "i int, t string")
    for local in (0, R.LOCAL_POSTINGS):
        got = sorted((r.i, r["rank"], r.kb_id) for r in R.sparse_hits(df, ["i"], "t", index, local_postings=local).collect())
        assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a"), (2, 2, "b"), (2, 3, "c")]
        assert R.sparse_hits(df.limit(0), ["i"], "t", index, local_postings=local).count() == 0
    assert R.score_claims(df, ["i"], "t", R.build_index(kb.limit(0), "kb_id", "content")).count() == 2


@pytest.mark.parametrize("head", [100_000, 1])
def test_unknown_terms_go_before_they_are_counted(spark, monkeypatch, head):
    """Of texts whose terms stand in no passage next to nothing reaches the count and the join with the tail."""
    met, look_up = [], R.look_up
    monkeypatch.setattr(R, "look_up", lambda terms, *a, **b: met.append(terms.count()) or look_up(terms, *a, **b))
    index = R.build_index(spark.createDataFrame([(1, "iron rusts"), (2, "water boils")], "kb_id long, content string"), "kb_id", "content")
    texts = [(i, " ".join(f"own{i}x{j}" for j in range(100))) for i in range(20)] + [(20, "iron boils"), (20, "iron"), (None, "water")]
    got = R.weigh(spark.createDataFrame(texts, "i long, t string"), ["i"], "t", index, [], head_terms=head)
    assert sorted((r.i or 0, r.term, round(r.w, 6)) for r in got.collect()) == [(0, "water", 1.0), (20, "boils", 0.447214), (20, "iron", 0.894427)]
    assert met[0] < 400

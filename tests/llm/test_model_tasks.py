"""The language model's tasks in Bits.java against the same model in numpy, one process, and words against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm

ODD = ["", None, " \t\n", "One  two\x0bTHREE\x0cone\r\n", "Ünï ÉTÉ été \x1f\x85x 日本語", "a\x00b a\x00b", "x" * 3000 + " y", "the cat sat " * 700]


def made_up(seed, texts):
    rng = np.random.default_rng(seed)
    words = ["".join(chr(x) for x in rng.integers(97, 103, n)) for n in rng.integers(1, 12, 80)]
    return [" ".join(words[int(79 * x * x)] for x in rng.random(size)) for size in rng.integers(0, 400, texts)] + ODD


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def learned(texts):
    learner = lm.Learner()
    for at in range(0, len(texts), lm.SLICE_ROWS):
        learner.learn([tokens(t) for t in texts[at : at + lm.SLICE_ROWS]])
    return learner


@pytest.mark.parametrize("piece, batch, slice_rows", [(100_000, 1 << 13, 500), (37, 1 << 7, 20), (300, 100, 3)])
def test_tasks_learn_what_one_process_learns(spark, monkeypatch, piece, batch, slice_rows):
    monkeypatch.setattr(lm, "PIECE_WORDS", piece)
    monkeypatch.setattr(lm, "BATCH_BYTES", batch)
    monkeypatch.setattr(lm, "SLICE_ROWS", slice_rows)
    texts = made_up(1, 60)
    rows = spark.createDataFrame([(t, False) for t in texts], "text string, held boolean").coalesce(1)
    got, want = lm.train_model(rows), lm.as_model(learned(texts).state())
    assert np.array_equal(got.odds, want.odds) and np.array_equal(got.level, want.level)
    assert got.weights == pytest.approx(want.weights, abs=1e-4) and got.steps == pytest.approx(want.steps, abs=1e-4)


def test_tasks_score_as_one_process(spark):
    texts = made_up(2, 40)
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    model = lm.as_model(learned([t for k, t in rows if not held[k]]).state())
    counts = Counter(w for k, t in rows if not held[k] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for k, text in rows:
        words = tokens(text)
        score = lm._by_text(*lm.score_sequences(model, [words]), np.array([len(words)]))[0]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_bytes, r.n_known) == (held[k], len(words), sum(map(len, words)) + len(words), sum(w in counts for w in words))
        assert r.score == pytest.approx(score, rel=1e-5) and r.base_score == pytest.approx(base)


def test_large_counts_have_the_logarithms_of_floats(spark):
    """A context met more often than the table of logarithms reaches."""
    texts = ["ab " * 3000] * 4
    rows = spark.createDataFrame([(t, False) for t in texts], "text string, held boolean").coalesce(1)
    got, want = lm.train_model(rows), lm.as_model(learned(texts).state())
    assert np.array_equal(got.odds, want.odds) and got.weights == pytest.approx(want.weights, abs=1e-3)


def test_bits_and_words_never_pass_through_python(spark):
    """Python took 3520 of 3940 CPU seconds a GB; only the tables of fixed size are still added up there."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = docs.select("text", F.lit(False).alias("held"))
    for frame in (lm.score_documents(docs), lm.build_lexicon(rows)):
        plan = frame._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan and "MapPartitions" in plan


def test_keys_of_any_type_come_back(spark):
    docs = spark.sql("SELECT * FROM VALUES (DATE'2020-01-02', 'a b'), (NULL, 'a'), (DATE'1990-05-06', NULL) AS t(doc_id, text)")
    got = lm.score_documents(docs)
    assert dict(got.dtypes)["doc_id"] == "date"
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == [("1990-05-06", 1), ("2020-01-02", 3), ("None", 2)]

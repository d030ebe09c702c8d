"""The language model: contexts across words, online learning, pieces of long texts."""

import math
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import lm


def tokens(text):
    return [*text.split(), b""]


def test_order_of_words_counts(spark):
    ids = [k for k in range(60)]
    rows = [(k, "the grey cat sat on my old mat") for k in ids] + [(1000, "the grey cat sat on my old mat"), (1001, "mat old my on sat cat grey the")]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] > got[1001] + 1


def test_every_occurrence_is_counted_under_what_stands_before_it():
    texts = [tokens(b"ab ab cd ab"), tokens(b"cd ab"), tokens(b"ab ab")]
    learner = lm.Learner()
    learner.learn(texts)
    seen = Counter()
    for words in texts:
        for before, word in zip([None, *words], words):
            seen[before, word] += 1
    coded = lm.encode([b"ab", b"ab"], np.zeros(2, np.int64))
    counts = learner.counts[coded.slots_of(slice(None))[lm.PAIR]]
    first, after = counts[0, 0], counts[3, 0]  # the first bit of a word, by the word before it
    at = lambda before, bit: sum(n for (b, w), n in seen.items() if b == before and (w or b" ")[0] >> 7 == bit)
    assert (first & 0xFFFFFFFF, first >> 32) == (at(None, 0), at(None, 1)) == (3, 0)
    assert (after & 0xFFFFFFFF, after >> 32) == (at(b"ab", 0), at(b"ab", 1)) == (6, 0)


def test_all_gates_learn_online():
    learner = lm.Learner()
    rng = np.random.default_rng(3)
    vocabulary = [bytes(rng.integers(97, 123, 6).astype(np.uint8)) for _ in range(40)]
    for _ in range(40):
        learner.learn([[*(vocabulary[i] for i in rng.integers(0, 40, 300)), b""]])
    moved = np.abs(learner.weights - lm.fresh_weights()).sum(axis=1) > 0
    used = learner.slope.sum(axis=1) > 0
    well_known = np.arange(lm.GATES) // 8 % 8 >= lm.KNOWN
    assert (used & well_known).any() and np.array_equal(moved, used)
    # learned from the texts: better than a uniform choice of bytes, and than what was not trained
    model, text = lm.as_model(learner.state()), [[*vocabulary[:20], b""]]
    trained, fresh = (lm.score_sequences(m, text)[0].sum() for m in (model, lm.as_model(lm.Learner().state())))
    assert trained > fresh / 3 and fresh == pytest.approx(-141 * 8 * math.log10(2), rel=1e-3)


def test_pieces_of_a_long_text_score_as_the_whole(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [[*(bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(1, 9, size)), b""] for size in (0, 1, 90, 300, 5)]
    learner = lm.Learner()
    learner.learn(texts)
    model = lm.as_model(learner.state())
    whole, hashes = lm.score_sequences(model, texts)
    for size in (1, 7, 64):
        monkeypatch.setattr(lm, "PIECE_WORDS", size)
        cut, same = lm.score_sequences(model, texts)
        assert np.array_equal(same, hashes) and cut == pytest.approx(whole)


def test_adapting_to_a_text_by_brute_force():
    texts = [tokens(b"a b a a c b"), tokens(b""), tokens(b"d d d")]
    words = [w for t in texts for w in t]
    p = -np.arange(1, len(words) + 1) / 3
    hashes = np.array([hash(w) & 0xFFFF for w in words], np.uint64)
    got, at = lm._by_text(p, hashes, np.array([len(t) for t in texts])), 0
    for score, text in zip(got, texts):
        own = p[at : at + len(text)]
        at += len(text)
        options = [own.sum()] + [
            sum(math.log10((s * 10**x + text[:i].count(w)) / (s + i)) for i, (w, x) in enumerate(zip(text, own))) for s in lm.STRENGTHS
        ]
        assert score == pytest.approx(math.log10(sum(10**x for x in options) / len(options)))


def test_counts_by_halves_of_a_byte_are_those_of_its_bits():
    learner = lm.Learner()
    assert learner.after.nbytes == 4 * lm.SLOTS and len(learner.state()) < lm.SLOTS * 1.1  # one number for each slot
    rng = np.random.default_rng(8)
    texts = [[*(bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in rng.integers(1, 5, 700)), b""] for _ in range(8)]
    learner.learn(texts)
    zeros, ones = Counter(), Counter()
    for coded, _ in lm.pieces(texts):
        for slots in coded.slots_of(slice(None)):
            ones.update(slots[coded.bits].tolist())
            zeros.update(slots[~coded.bits].tolist())
    counts = learner.counts
    assert {int(k): int(counts[k] >> 32) for k in np.flatnonzero(counts >> 32)} == ones
    assert {int(k): int(counts[k] & 0xFFFFFFFF) for k in np.flatnonzero(counts & 0xFFFFFFFF)} == zeros

"""Language model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of words in small letters and one end. Words are coded one after another as they stand, bit by
bit: a word's bytes from the left and a blank after the last; the end is the empty word. Every predictor sees what
comes before the bit under another context: the last 2, 3, 4 or 6 bytes of the text, across words; the word so far;
the word so far and the word before it. It knows how often ones and zeros followed, in a table of hashed slots.
A mixer adds the predictors' log odds under weights that are picked by a gate; an adaptive map then corrects its output
by what came true. All three learn online, as a task goes through its texts: bits are predicted from what came before
them, and counted afterwards, every occurrence of every word. What the tasks have learned is added up.

Within a text the model adapts: a word already seen in it gains in proportion to how often it was seen, at several
strengths, which are weighed by how well they have predicted the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import jvm
from plumbline.llm import words as W
from plumbline.session import materialise

ORDERS = (2, 3, 4, 6, 0, -1)  # bytes of context; 0 stands for the word so far, -1 for that and the word before
TABLE_BITS = (18, 19, 20, 20, 20, 21)
WHOLE, PAIR = 4, 5
START = np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS])))
SLOTS = int(START[-1])
BLOCK = 1 << 14
FAN_IN = 64
# Levels of how much the last two predictors have seen, the byte's depth and the bit's place choose the mixer's weights.
LEVELS = {WHOLE: (1, 2, 4, 8, 32, 256, 4096), PAIR: (1, 4, 32)}
GATES = 2 * 4 * 8 * 8
DEEP = 5  # bytes into a word
KNOWN = 6  # the level of the word so far from which the mixer starts out with it alone
STEPS = 33
PRIOR = 0.02
RATE = 0.1
REFINED = 0.25
BATCH_BYTES = 1 << 13  # bits predicted before what they teach is added
SCORED_BYTES = 1 << 10  # scored at once; arrays of this size are reused without asking the system for memory
PIECE_WORDS = 100_000
SLICE_ROWS = 500
FLUSH_WORDS = 250_000
# The words with at least this share of the training words are at most 1 / share; only short ones are broadcast.
HOT_SHARE = 1 / 200_000
HOT_BYTES = 64
STRENGTHS = (100.0, 1000.0, 10_000.0, 100_000.0)
WORD = 77  # sets the hashes of words apart
_SCATTER = np.uint64(0xD6E8FEB86659FD93)
_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1).astype(bool)
AT_ONCE = 1 << 13  # bytes whose contexts are hashed at once, in the cache
# Which of the 15 slots for half a byte stands for its bits so far.
_NODES = np.stack([(half >> (4 - j)) | (1 << j) for half in (np.arange(256) >> 4, np.arange(256) & 15) for j in range(4)], axis=1).reshape(256, 2, 4)

JAVA = Path(__file__).with_name("Bits.java")


@dataclass
class Coded:
    """The bits of a list of words: the slots of each predictor, the bit, and the word of each byte."""

    data: np.ndarray
    slots: np.ndarray  # (orders, bytes, 2): where the slots of each half of a byte begin, each order in its own stretch
    word: np.ndarray  # (bytes,)
    inside: np.ndarray  # (bytes,): how many bytes of the word come before
    hashes: np.ndarray  # (words,)

    @property
    def bits(self) -> np.ndarray:  # (bytes, 8)
        return _BITS[self.data]

    def slots_of(self, rows: slice) -> list[np.ndarray]:
        """The slots of each order, (bytes, 8)."""
        nodes = _NODES[self.data[rows]]
        return [(self.slots[i, rows, :, None] + nodes).reshape(-1, 8) for i in range(len(ORDERS))]

    def halves(self, rows: slice) -> np.ndarray:
        """Both halves of each byte, one after the other."""
        data = self.data[rows]
        return np.stack((data >> 4, data & 15), axis=1).reshape(-1).astype(np.int64)


def encode(words: list, text: np.ndarray | None = None) -> Coded:
    """Code words in order; contexts reach back over the words of the same ``text``, by default each word is one."""
    blob = b"".join([w.encode() + b" " for w in words]) if text is None else b" ".join([*words, b""])
    data = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(data == 0x20) + 1
    starts = np.concatenate(([0], ends[:-1]))
    word = np.repeat(np.arange(len(words), dtype=np.int64), ends - starts)
    text = np.arange(len(words)) if text is None else text
    opens = np.ones(len(words), bool)
    opens[1:] = text[1:] != text[:-1]
    begin = starts[np.maximum.accumulate(np.where(opens, np.arange(len(words)), 0))]
    inside, since = np.arange(len(data)) - np.repeat(starts, ends - starts), np.arange(len(data)) - np.repeat(begin, ends - starts)
    wide = data.astype(np.uint64) + np.uint64(1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide * W._power("up", len(data)))))
    down = W._power("down", len(data) + 1)
    size = ends - starts
    whole = sums[:-1] - np.repeat(sums[starts], size)
    whole *= np.repeat(down[starts], size)
    hashes = W.mix((sums[ends] - sums[starts]) * down[starts], WORD)
    before = np.zeros(len(words), np.uint64)
    before[1:] = np.where(opens[1:], np.uint64(0), hashes[:-1])
    half = ((data >> 4).astype(np.uint64) + np.uint64(1)) * np.uint64(W.BASE)
    slots = np.empty((len(ORDERS), len(data), 2), np.int32)
    past = np.zeros(len(data), np.uint64)
    reach = 0
    for i, order in enumerate(ORDERS):
        while order > reach:  # one byte further back
            reach += 1
            past *= np.uint64(257)
            past[reach:] += wide[:-reach] * (since[reach:] >= reach)
        context = past if order > 0 else whole if order == 0 else whole + np.repeat(before, size)
        for at in range(0, len(data), AT_ONCE):
            here = slice(at, at + AT_ONCE)
            x = np.stack((context[here], context[here] + half[here]))
            x *= _SCATTER
            x ^= x >> np.uint64(32)
            x *= _SCATTER
            x >>= np.uint64(64 - TABLE_BITS[i] + 4)
            x <<= np.uint64(4)
            x += np.uint64(START[i])
            slots[i, here] = x.T
    return Coded(data, slots, word, inside, hashes)


def pieces(texts: list[list[bytes]]) -> Iterator[tuple[Coded, int]]:
    """The words of the texts in order, coded in pieces of bounded length, with how many words a piece begins with
    that were coded before: where a text is cut, the next piece repeats the words that contexts reach back to."""
    words, text, lead = [], [], 0
    for i, own in enumerate(texts):
        at = 0
        while at < len(own):
            take = own[at : at + PIECE_WORDS]
            words += take
            text.append(np.full(len(take), i))
            at += len(take)
            if len(words) - lead >= PIECE_WORDS:
                yield encode(words, np.concatenate(text)), lead
                back, size = at, 0
                while back > 0 and size < max(ORDERS):
                    back -= 1
                    size += len(own[back]) + 1
                words = own[back:at] if at < len(own) else []
                lead = len(words)
                text = [np.full(lead, i)]
    if len(words) > lead:
        yield encode(words, np.concatenate(text)), lead


@dataclass
class Model:
    """Tables of fixed size: log odds and level of each slot (0 where nothing was seen), mixer weights, adaptive map."""

    odds: np.ndarray
    level: np.ndarray
    weights: np.ndarray
    steps: np.ndarray


_LEVEL = {i: np.searchsorted(bounds, np.arange(bounds[-1] + 1), "right") for i, bounds in LEVELS.items()}


def _level(i: int, seen: np.ndarray) -> np.ndarray:
    return _LEVEL[i].take(np.minimum(seen, LEVELS[i][-1]).astype(np.int64), mode="clip")


def _gate(inside: np.ndarray, pair: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The gate of each bit, (4, halves): the bits of half a byte lie below each other."""
    gate = pair * 64
    gate += whole * 8
    gate += np.arange(4)[:, None]
    gate += np.stack(((inside >= DEEP) * 256, (inside >= DEEP) * 256 + 4), axis=1).reshape(-1)
    return gate


def _lines(table: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rows of 16 entries, one after the other."""
    kind = f"V{16 * table.itemsize}"
    out = out[: 16 * len(at)]
    return table.reshape(-1).view(kind).take(at, mode="clip", out=out.view(kind)).view(table.dtype)


def _bits_of(halves: np.ndarray) -> np.ndarray:
    """(4, halves)."""
    return (halves >> np.arange(3, -1, -1)[:, None] & 1).astype(bool)


def _nodes(halves: np.ndarray) -> np.ndarray:
    """Where, among the 16 slots of each of the halves in a row, its bits so far are, (4, halves)."""
    return np.stack([(halves >> (4 - j)) + (1 << j) for j in range(4)]) + np.arange(0, 16 * len(halves), 16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -20.0, 20.0)))


def _step(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower of the two steps of the adaptive map around a mixer's output, and the share of the upper one."""
    at = np.clip(mixed * 2 + (STEPS - 1) / 2, 0, STEPS - 1.001)
    low = at.astype(np.int64)
    return low, at - low


def fresh_weights() -> np.ndarray:
    """Where learning starts: with the word so far where that is well known, else with all contexts alike."""
    weights = np.full((2, 4, 8, 8, len(ORDERS)), 0.3)
    weights[:, :, KNOWN:] = 0.0
    weights[:, :, KNOWN:, :, WHOLE] = 1.0
    return weights.reshape(GATES, len(ORDERS))


def _score(model: Model, coded: Coded) -> np.ndarray:
    """log10 of the probability of each word, after what stands before it."""
    steps, weights = model.steps.astype(np.float32).reshape(-1), np.ascontiguousarray(model.weights.T, np.float32)
    sums = np.zeros(len(coded.word))
    room = [np.empty(32 * SCORED_BYTES, table.dtype) for table in (model.odds, model.level)]
    for at in range(0, len(coded.word), SCORED_BYTES):
        rows = slice(at, at + SCORED_BYTES)
        halves = coded.halves(rows)
        nodes = _nodes(halves)
        lines = [(coded.slots[i, rows].reshape(-1) >> 4).astype(np.int64) for i in range(len(ORDERS))]
        gate = _gate(coded.inside[rows], *(_lines(model.level, lines[i], room[1]).take(nodes, mode="clip").astype(np.int64) for i in (PAIR, WHOLE)))
        mixed = np.zeros(gate.shape, np.float32)
        for i in range(len(ORDERS)):
            mixed += _lines(model.odds, lines[i], room[0]).take(nodes, mode="clip") * weights[i].take(gate, mode="clip")
        low, share = _step(mixed)
        place = gate * STEPS + low
        refined = steps.take(place, mode="clip") * (1 - share) + steps.take(place + 1, mode="clip") * share
        p = np.clip(_sigmoid(mixed) * (1 - REFINED) + refined * REFINED, 1e-6, 1 - 1e-6)
        sums[rows] = np.log10(np.where(_bits_of(halves), p, 1 - p)).sum(axis=0).reshape(-1, 2).sum(axis=1)
    return np.bincount(coded.word, sums, len(coded.hashes))


def score_words(model: Model, words: list[str]) -> np.ndarray:
    """log10 of each word's probability as the first of a text."""
    return _score(model, encode(words))


def score_sequences(model: Model, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the probability of each word of the texts where it stands, and a hash of each."""
    found = [(_score(model, coded)[lead:], coded.hashes[lead:]) for coded, lead in pieces(texts)]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0), np.zeros(0, np.uint64))


def _node_counts(after: np.ndarray) -> np.ndarray:
    """Zeros and ones that followed each slot, (contexts, 16, 2), from the halves of a byte that followed its context, (contexts, 16)."""
    out = np.zeros((len(after), 16, 2), after.dtype)
    for nodes in (8, 4, 2, 1):
        out[:, nodes : 2 * nodes] = after.reshape(len(after), nodes, 2)
        after = after[:, ::2] + after[:, 1::2]
    return out


def _log_odds(seen: np.ndarray) -> np.ndarray:
    logs = np.log(seen + np.float32(PRIOR))
    return logs[..., 1] - logs[..., 0]


def _summed(rows: DataFrame, values: int) -> dict[int, np.ndarray]:
    """Add packed arrays (block, part, values) by block, as a tree; blocks are few, of fixed size."""

    def add(key, table):
        total = np.zeros(values)
        for x in table.column("packed"):
            total += np.frombuffer(x.as_py(), np.float32)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py() // FAN_IN if len(key) > 1 else 0], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["block", "part", "packed"])

    for keys in (("block", "part"), ("block", "part"), ("block",)):
        rows = rows.groupBy(*keys).applyInArrow(add, "block int, part int, packed binary")
    return {r["block"]: np.frombuffer(r["packed"], np.float32) for r in rows.collect()}


class Learner:
    """What one task learns from its texts, in their order."""

    def __init__(self):
        self.after = np.zeros((SLOTS // 16, 16), np.int32)  # how often each half of a byte followed a context
        # written over by each batch, as asking the system for memory each time costs more than the sums
        self.lines, self.sums = np.empty((2, 32 * BATCH_BYTES), np.int32)
        self.met, self.missed = np.empty((2, 5, 2 * BATCH_BYTES), np.float32)
        self.odds = np.empty((len(ORDERS), 4, 2 * BATCH_BYTES), np.float32)
        self.part, self.product = np.empty(8 * BATCH_BYTES, np.float32), np.empty(8 * BATCH_BYTES)
        self.weights = fresh_weights()
        self.slope = np.zeros_like(self.weights)
        self.came = np.zeros((2, GATES * STEPS))
        self.seen = np.zeros(GATES)

    @property
    def counts(self) -> np.ndarray:
        """What followed each slot: ones in the upper 32 bits, zeros in the lower."""
        zeros, ones = _node_counts(self.after).reshape(-1, 2).T.astype(np.int64)
        return ones << 32 | zeros

    def learn(self, texts: list[list[bytes]]) -> None:
        for coded, lead in pieces(texts):
            first = int(np.searchsorted(coded.word, lead))
            for at in range(first, len(coded.word), BATCH_BYTES):
                self._batch(coded, slice(at, at + BATCH_BYTES))

    def _batch(self, coded: Coded, rows: slice) -> None:
        """Predict a batch of bits from what was counted before it, move the weights down the gradient, then count it."""
        halves = coded.halves(rows)
        right = _bits_of(halves)
        sign = np.where(right, np.float32(1), np.float32(-1))
        n = len(halves)
        slots = [coded.slots[i, rows].reshape(-1).astype(np.int64) for i in range(len(ORDERS))]
        paths = [np.arange(0, n << depth, 1 << depth) + (halves >> (4 - depth)) for depth in range(1, 5)]
        odds, levels = self.odds[:, :, :n], {}  # log odds of the bit that came
        met, missed = self.met[:, :n], self.missed[1:, :n]
        for i in range(len(ORDERS)):
            after, sums = _lines(self.after, slots[i] >> 4, self.lines), self.sums
            for depth in (4, 3, 2, 1):  # how often the context was met with the first bits of the half, none to all four
                met[depth] = after.take(paths[depth - 1], mode="clip")
                after, sums = np.add(after[::2], after[1::2], out=sums[: len(after) // 2]), sums[len(after) // 2 :]
            met[0] = after
            if i in LEVELS:
                levels[i] = _level(i, met[:-1])
            np.subtract(met[:-1], met[1:], out=missed)
            for x in (missed, met[1:]):
                x += np.float32(PRIOR)
                np.log(x, out=x)
            np.subtract(met[1:], missed, out=odds[i])  # 0 where nothing was seen
        gate = _gate(coded.inside[rows], levels[PAIR], levels[WHOLE])
        at, part, product = gate.reshape(-1), self.part[: 4 * n], self.product[: 4 * n]
        mixed = np.zeros(gate.shape, np.float32)
        for i in range(len(ORDERS)):
            self.weights[:, i].astype(np.float32).take(at, mode="clip", out=part)
            mixed += np.multiply(part.reshape(4, n), odds[i], out=part.reshape(4, n))
        mixed *= sign
        low, share = _step(mixed)
        place = gate * STEPS + low
        place = (place + right * (GATES * STEPS)).reshape(-1)
        upper = np.bincount(place, share.reshape(-1), 2 * GATES * STEPS).reshape(2, -1)
        came = np.bincount(place, minlength=2 * GATES * STEPS).reshape(2, -1) - upper
        came[:, 1:] += upper[:, :-1]
        self.came += came[0] + came[1], came[1]
        total = np.bincount(at, minlength=GATES)
        self.seen += total
        error = (right - _sigmoid(mixed)) * sign
        gradient = np.empty((GATES, len(ORDERS)))
        for i in range(len(ORDERS)):
            np.multiply(error, odds[i], out=product.reshape(4, n))
            gradient[:, i] = np.bincount(at, product, GATES)
        gradient /= np.maximum(total, 1)[:, None]
        self.slope += gradient**2
        self.weights += RATE * gradient / (np.sqrt(self.slope) + 1e-6)
        one = np.ones(n, np.int32)
        for i in range(len(ORDERS)):
            np.add.at(self.after.reshape(-1), slots[i] + halves, one)

    def state(self) -> np.ndarray:
        """All of it in one array; arrays of several tasks add up."""
        return np.concatenate((self.after.reshape(-1), (self.weights * self.seen[:, None]).reshape(-1), self.came.reshape(-1), self.seen), dtype=np.float32, casting="unsafe")


def as_model(state: np.ndarray) -> Model:
    """The model that predicts from summed states: weights are averaged by the bits they saw."""
    at = np.cumsum([SLOTS, GATES * len(ORDERS), 2 * GATES * STEPS, GATES])
    after, weights, came, seen = np.split(state[: at[-1]], at[:-1])
    counts, came, seen = _node_counts(after.reshape(-1, 16)).reshape(SLOTS, 2), came.reshape(2, GATES, STEPS).astype(float), seen[:, None].astype(float)
    weights = np.where(seen > 0, weights.reshape(GATES, -1) / np.maximum(seen, 1e-9), fresh_weights())
    centre = _sigmoid((np.arange(STEPS) - (STEPS - 1) / 2) / 2)
    level = np.zeros(SLOTS, np.uint8)
    for i in LEVELS:
        own = slice(START[i], START[i + 1])
        level[own] = _level(i, counts[own].sum(axis=1))
    return Model(_log_odds(counts).astype(np.float16), level, weights, (came[1] + 2 * centre) / (came[0] + 2))


def _java(spark, name: str):
    """One of the functions over partitions in Bits.java, with the fixed values of this module."""
    own = ("ORDERS", "TABLE_BITS", "WHOLE", "PAIR", "SLOTS", "BLOCK", "FAN_IN", "GATES", "DEEP", "KNOWN", "STEPS", "PRIOR", "RATE", "REFINED", "BATCH_BYTES", "PIECE_WORDS", "SLICE_ROWS", "FLUSH_WORDS", "STRENGTHS")
    constants = {key: globals()[key] for key in own} | {
        "START": START.tolist(), "WHOLE_BOUNDS": LEVELS[WHOLE], "PAIR_BOUNDS": LEVELS[PAIR],
        "BASE": W.BASE, "SCATTER": int(_SCATTER), "WORD_SEED": W.seed_value(WORD),
    }
    return jvm.create(spark, JAVA, constants, f"Bits${name}")


def train_model(rows: DataFrame) -> Model:
    """A model of the texts of ``rows`` (text, held) that are not held out. Its size does not depend on the corpus."""
    size = SLOTS + GATES * (len(ORDERS) + 2 * STEPS + 1)
    blocks = -(-size // BLOCK)

    texts = rows.filter("not held").select(F.col("text").cast("binary"))
    learned = jvm.map_partitions(texts, _java(rows.sparkSession, "Learn"), "block int, part int, packed binary")
    state = np.zeros(blocks * BLOCK, np.float32)
    for b, part in _summed(learned, BLOCK).items():
        state[b * BLOCK : (b + 1) * BLOCK] = part
    return as_model(state)


def build_lexicon(rows: DataFrame) -> DataFrame:
    """Every distinct word of ``rows`` (text, held) with its count among those not held out; the end is the empty word."""

    texts = rows.select(F.col("text").cast("binary"), "held")
    counted = jvm.map_partitions(texts, _java(rows.sparkSession, "Count"), "word binary, c long")
    return counted.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("c").alias("c"))


def _by_text(p: np.ndarray, hashes: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """log10 of each text's probability from that of its words: the mean of those as given and of those that adapt,
    where a word seen r times among the i before it has probability (strength * p + r) / (strength + i)."""
    text = np.repeat(np.arange(len(n_tokens)), n_tokens)
    order = np.lexsort((hashes, text))  # stable: equal words stay in their order
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    met = np.empty(len(order), np.int64)
    met[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    before = np.arange(len(text)) - np.repeat(np.cumsum(n_tokens) - n_tokens, n_tokens)
    options = [p] + [np.log10(np.maximum((s * 10.0**p + met) / (s + before), 1e-300)) for s in STRENGTHS]
    # a word too unlikely for a double keeps its logarithm
    options[1:] = [np.where(met > 0, x, math.log10(s) + p - np.log10(s + before)) for x, s in zip(options[1:], STRENGTHS)]
    options = np.stack([np.bincount(text, x, len(n_tokens)) for x in options])
    best = options.max(axis=0)
    return best + np.log10((10.0 ** (options - best)).mean(axis=0))


STATS = "struct<id:{0}, held:boolean, n_tokens:long, n_bytes:long, n_known:long, base:double, score:double>"


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 1) -> DataFrame:
    """Score every whole text by a model of the texts outside the held-out fold, and by a unigram base.

    ``held_out`` says whether crc32 of the key as text is ``fold`` modulo 5; those texts are not learned from. The base
    adds log10((c + 0.5) / (N + 0.5 (V + 1))) over a text's tokens. ``score`` is log10 of the model's probability of
    the tokens in their order, ``bits_per_byte`` the same in bits over the bytes of the words and the blanks after them.

    The model reads the texts twice, to learn and to score, and is all that is broadcast for it. For the base, words
    are counted map-side. Those with a share of ``HOT_SHARE`` or more of all words, a bounded number, are added
    where they stand; the others meet their counts in a shuffled join, once per text.

    Returns ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``n_bytes`` and
    ``bits_per_byte``, one row per row of ``docs``. Null and empty texts are one end. A null key counts as empty text
    for the fold. Rows with the same key are scored each for itself; further columns are ignored. Without training
    texts all counts are zero and every bit has even odds; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[key]
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == fold
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), held.alias("held"))
    spark = docs.sparkSession
    lexicon = materialise(build_lexicon(rows), "lexicon")
    total = lexicon.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n_train, v_train = total["n"] or 0, total["v"] or 0
    scale = n_train + 0.5 * (v_train + 1)
    often = lexicon.filter((F.col("c") >= max(1.0, n_train * HOT_SHARE)) & (F.octet_length("word") <= HOT_BYTES))
    found = often.collect()  # at most 1 / HOT_SHARE words of HOT_BYTES
    names = b"".join(r["word"].encode() + b" " for r in found)
    model = train_model(rows)  # of fixed size, and so is what is broadcast of it
    score = _java(spark, "Score")
    parts = model.odds, model.level[START[WHOLE] :], model.weights.astype("<f4"), model.steps.astype("<f4"), names, np.array([r["c"] for r in found], "<i8")
    for i, part in enumerate(parts):
        part = part if isinstance(part, bytes) else part.tobytes()
        for at in range(0, len(part), jvm.CHUNK):
            score.add(i, part[at : at + jvm.CHUNK])
    score.share(spark.sparkContext._jsc, float(scale))
    numbered = rows.select("id", F.col("text").cast("binary"), "held", F.monotonically_increasing_id())
    asked = jvm.map_partitions(numbered, score, f"row long, word binary, n int, stats {STATS.format(kind)}").withColumn("word", F.col("word").cast("string"))
    joined = asked.join(lexicon, "word", "left").select("row", "n", "c", "stats")
    joined = joined.repartition(F.col("row"))
    summed = joined.groupBy("row").agg(
        F.max("stats").alias("own"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n").cast("double") * F.log10((F.col("c") + 0.5) / scale)).alias("base"),
    )
    return summed.select(
        F.col("own.id").alias(key), F.col("own.held").alias("held_out"), "own.n_tokens",
        (F.col("own.n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("own.base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "own.score", "own.n_bytes",
    ).withColumn("bits_per_byte", -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes"))

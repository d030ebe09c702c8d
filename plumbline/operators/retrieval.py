"""Claim support by tf-idf or dense vectors: exact top-k hits and the scores built on them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import constants as K
from plumbline.functions import text as TX
from plumbline.operators.skew import join_to_unique, may_match, small_enough
from plumbline.session import materialise

# Passages of one block of the index; smaller blocks are grouped up to as many. Texts that share one copy of a group.
BLOCK_PASSAGES = 2_048
GROUP_TEXTS = 16_384
# An index up to this size is broadcast, and texts are searched where they are read.
LOCAL_POSTINGS = 1_000_000
# Terms of the dictionary's head, which is broadcast once its bytes are checked; the tail is shuffled.
HEAD_TERMS = 100_000
# Sums that a task holds at once.
SLICE_SUMS = 4_000_000
# Similarities are compared at nine digits, so bounds leave room for rounding.
ROOM = 1e-8


@dataclass(frozen=True)
class TermIndex:
    """A knowledge base as a weighted inverted index, cut by passage into blocks, and these into groups.

    A group is what a task holds; bounds leave groups unread, and blocks within them.
    ``dictionary`` has per term its idf, its largest weight, the block and group that hold it and the number of groups;
    ``group_terms`` the largest weight per term and group. ``first`` are the lowest ids: an exact index returns
    passages without a shared term too, in that order.
    """

    vocabulary: DataFrame  # term, df, cf, idf
    postings: DataFrame  # term, kb_id, w, block, group
    dictionary: DataFrame  # term, idf, most, best_block, best_group, n_groups
    group_terms: DataFrame  # term, group, most
    first: list
    n_docs: int


def term_counts(df: DataFrame, keys: Sequence[str], column: str, stop_words=None) -> DataFrame:
    """(keys, term, tf) of words and adjacent word pairs."""
    # the words are a column of their own, or each use would extract them anew
    found = df.select(*keys, TX.words(F.col(column), stop_words).alias("_words"))
    long = found.select(*keys, F.explode(TX.word_pairs(F.col("_words"))).alias("term"))
    return long.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def smoothed_idf(df: Column, n_docs: int) -> Column:
    return F.log((1.0 + n_docs) / (1 + df)) + 1


def unit_norm(w: Column, keys: Sequence[str]) -> Column:
    """Weight over the length of its vector; a zero vector stays zero."""
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy(*keys)))
    return F.coalesce(F.try_divide(w, norm), F.lit(0.0))


def build_index(
    kb: DataFrame,
    kb_id: str,
    content: str,
    max_terms: int | None = None,
    stop_words: list[str] | None = None,
    anchors: int = K.TOP_K,
    block_passages: int = BLOCK_PASSAGES,
) -> TermIndex:
    """Index a knowledge base: all its terms, or the ``max_terms`` most frequent; smoothed idf, unit vectors."""
    kb = kb.withColumnRenamed(kb_id, "kb_id")
    n_docs = kb.count()
    counts = materialise(term_counts(kb, ["kb_id"], content, stop_words), "passage-terms")
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    if max_terms is not None:
        vocabulary = vocabulary.orderBy(F.col("cf").desc(), "term").limit(max_terms)
    vocabulary = materialise(vocabulary.withColumn("idf", smoothed_idf(F.col("df"), n_docs)), "vocabulary")
    known = vocabulary.select("term", "idf")
    weighed = join_to_unique(counts, known, "term", ["kb_id"], "inner").withColumn("_w", F.col("tf") * F.col("idf"))
    n_blocks = max(1, math.ceil(n_docs / block_passages))
    block = F.pmod(F.xxhash64("kb_id"), F.lit(n_blocks)).cast("int")
    group = F.floor(F.col("block") / max(1, BLOCK_PASSAGES // block_passages)).cast("int")
    postings = weighed.select("term", "kb_id", unit_norm(F.col("_w"), ["kb_id"]).alias("w"), block.alias("block"))
    postings = materialise(postings.withColumn("group", group), "postings")
    by_group = postings.groupBy("term", "group").agg(F.max("w").alias("most"), F.max_by("block", "w").alias("best_block"))
    by_group = materialise(by_group, "group-terms")
    best = by_group.groupBy("term").agg(
        F.max("most").alias("most"), F.max_by(F.struct("best_block", "group"), "most").alias("_best"), F.count(F.lit(1)).cast("int").alias("n_groups")
    )
    best = best.select("term", "most", "_best.best_block", F.col("_best.group").alias("best_group"), "n_groups")
    dictionary = materialise(join_to_unique(best, known, "term", ["term"], "inner"), "dictionary")
    first = [r["kb_id"] for r in kb.select("kb_id").orderBy("kb_id").limit(anchors).collect()]
    return TermIndex(vocabulary, postings, dictionary, by_group.drop("best_block"), first, n_docs)


def spread(texts: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Texts hashed by their keys; every use within one query shares the same shuffle."""
    return texts.select(*keys, column).repartition(*keys)


def look_up(terms: DataFrame, dictionary: DataFrame, row_id: Sequence[str], head_terms: int = HEAD_TERMS) -> DataFrame:
    """Join (row, term) to the dictionary, which may be far larger than memory; unknown terms drop out.

    A dictionary of checked size is broadcast. Of a larger one the terms in most groups are, and meet most rows
    without a shuffle; the rest is shuffled, with the hot terms of the rows salted.
    """
    if small_enough(dictionary, head_terms):
        return terms.join(F.broadcast(dictionary), "term")
    head = materialise(dictionary.orderBy(F.col("n_groups").desc(), "idf", "term").limit(head_terms), "dictionary-head")
    if not small_enough(head, head_terms):  # very long terms
        return join_to_unique(terms, dictionary, "term", row_id, "inner")
    names = [c for c in dictionary.columns if c != "term"]
    met = terms.join(F.broadcast(head.withColumn("_met", F.lit(True))), "term", "left")
    rare = met.filter(F.col("_met").isNull()).drop(*names, "_met")
    tail = dictionary.join(F.broadcast(head.select("term")), "term", "left_anti")
    columns = [*terms.columns, *names]
    return met.filter("_met").select(columns).unionByName(join_to_unique(rare, tail, "term", row_id, "inner").select(columns))


def _possible(terms: DataFrame, dictionary: DataFrame, head_terms: int) -> DataFrame:
    """Rows whose term may be in the dictionary: exactly so where it may be broadcast, else by a filter of bounded size."""
    if small_enough(dictionary, head_terms):
        return terms.join(F.broadcast(dictionary.select("term")), "term", "left_semi")
    return may_match(terms, dictionary, "term")


def _known_terms(texts: DataFrame, keys: Sequence[str], column: str, index: TermIndex, stop_words, head_terms: int) -> DataFrame:
    """(keys, term, tf, and the dictionary's columns) of texts that are spread by their keys.

    Most terms of a text stand in no passage; they go before terms are counted or shuffled.
    """
    found = texts.select(*keys, TX.words(F.col(column), stop_words).alias("_words"))
    long = found.select(*keys, F.explode(TX.word_pairs(F.col("_words"))).alias("term"))
    counted = _possible(long, index.dictionary, head_terms).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    return look_up(counted, index.dictionary, [*keys, "term"], head_terms)


def weigh(texts: DataFrame, keys: Sequence[str], column: str, index: TermIndex, stop_words=None, head_terms: int = HEAD_TERMS) -> DataFrame:
    """Unit tf-idf vectors of texts in the index's own vocabulary; unknown words drop out."""
    known = _known_terms(spread(texts, keys, column), keys, column, index, stop_words, head_terms)
    return known.select(*keys, "term", unit_norm(F.col("tf") * F.col("idf"), keys).alias("w"))


def top_hits(sims: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k best (keys, kb_id, sim) rows per text; ties go to the lower id.

    Similarities are ranked at nine digits: the last bits depend on summation order.
    """
    order = Window.partitionBy(*keys).orderBy(F.round("sim", 9).desc(), "kb_id")
    return sims.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Group:
    """One group of blocks in a task: posting lists by term and block over the group's passages."""

    def __init__(self, term: pa.Array, kb_id: pa.Array, w: np.ndarray, block: np.ndarray, more_ids: pa.Array | None = None):
        ids = kb_id.unique() if more_ids is None else pa.chunked_array([kb_id, more_ids]).unique()
        self.ids = ids.take(pc.sort_indices(ids))
        self.passage, self.w = pc.index_in(kb_id, value_set=self.ids).to_numpy(), w
        self.terms = term.unique()  # rows come in the order of terms and blocks
        self.blocks, own = np.unique(block, return_inverse=True)
        lists = pc.index_in(term, value_set=self.terms).to_numpy().astype(np.int64) * max(len(self.blocks), 1) + own
        start = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])) if len(lists) else np.zeros(0, np.int64)
        self.begin = np.append(start, len(w))  # of each list
        self.most = np.maximum.reduceat(w, start) if len(w) else np.zeros(0)
        place, self.block = np.divmod(lists[start], max(len(self.blocks), 1))
        self.first = np.searchsorted(place, np.arange(len(self.terms) + 1))  # of each term's lists

    def lists(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of terms, one after another, and to which of the terms each belongs."""
        return _ranges(self.first, place)

    def sums(self, text: np.ndarray, lists: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """Similarity of ``n`` texts with each passage, from the lists given for them."""
        at, of = _ranges(self.begin, lists)
        return np.bincount(text[of] * len(self.ids) + self.passage[at], w[of] * self.w[at], n * len(self.ids)).reshape(n, -1)


def _ranges(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from begin[i] up to begin[i + 1] for every i of ``which``, and the places of these i."""
    size = begin[which + 1] - begin[which]
    of = np.repeat(np.arange(len(which)), size)
    return np.arange(len(of)) + (begin[which] - np.cumsum(size) + size)[of], of


def _best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best passages of each text and their similarity, 0 where it shares no term; the lower id first."""
    sims, every = np.round(sums, 9), np.arange(len(sums))
    best, found = np.empty((len(sums), min(k, sims.shape[1])), np.int64), np.empty((len(sums), min(k, sims.shape[1])))
    for i in range(best.shape[1]):
        best[:, i] = at = sims.argmax(axis=1)
        found[:, i] = np.where(sims[every, at] > 0, sums[every, at], 0.0)
        sims[every, at] = -1.0
    return best, found


def _open_terms(text: np.ndarray, gain: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms without which no passage of another group could reach the k-th similarity, and what the others can add.

    A text's terms by rising gain, the most that a term can add in another group: those whose gains together stay
    below the k-th similarity can't reach it alone.
    """
    order = np.lexsort((gain, text))
    upto = np.cumsum(gain[order])
    start = np.searchsorted(text[order], text[order], "left")
    alone = upto - np.append(0.0, upto)[start]
    out = np.zeros(len(text), bool)
    out[order] = alone >= kth[text[order]] - ROOM
    out &= gain > 0
    return out, np.bincount(text[~out], gain[~out], len(kth)).astype(float)


def _probe(index: TermIndex, asked: DataFrame, k: int, first_round: bool) -> DataFrame:
    """The k best passages of one group for each text: (key, group, hits), and what is open after the first round.

    ``asked`` has key, group, block, kth and vector, an array of (term, w, most, best_group, n_groups). A group's
    postings come first in its task, and the texts then stream past them. Of the group a text reads the block asked
    for, if any, and those whose largest weights add up to the k-th similarity, that of the block read or the one given.
    """
    load = asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP_TEXTS).cast("int").alias("_copies"))
    load = materialise(load, "probed-groups")  # one row per group
    load = F.broadcast(load) if small_enough(load) else load
    postings = index.postings.join(load, "group").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    texts = asked.join(load, "group").withColumn("copy", F.pmod(F.xxhash64("key"), F.col("_copies")).cast("int"))
    kinds = {c: asked.schema[c].dataType for c in ("key", "kth", "vector")} | {c: index.postings.schema[c].dataType for c in ("term", "kb_id", "w")}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    both = postings.select("group", "copy", F.lit(0).alias("asks"), "block", "term", "kb_id", "w", none("key"), none("kth"), none("vector")).unionAll(
        texts.select("group", "copy", F.lit(1).alias("asks"), "block", none("term"), none("kb_id"), none("w"), "key", "kth", "vector")
    )
    met = both.repartition("group", "copy").sortWithinPartitions("group", "copy", "asks", "term", "block", "kb_id")
    open_term = T.StructType([T.StructField("term", T.StringType()), T.StructField("w", T.DoubleType())])
    hit = T.StructType([T.StructField("sim", T.DoubleType()), T.StructField("kb_id", kinds["kb_id"])])
    fields = [T.StructField("key", kinds["key"]), T.StructField("group", T.IntegerType()), T.StructField("hits", T.ArrayType(hit))]
    if first_round:
        fields += [T.StructField("kth", T.DoubleType()), T.StructField("rest", T.DoubleType()), T.StructField("open", T.ArrayType(open_term)), T.StructField("vector", kinds["vector"])]

    def answers(few: pa.RecordBatch, held: _Group, group: int) -> pa.RecordBatch:
        n, vector = few.num_rows, few.column(9)
        size = np.asarray(pc.list_value_length(vector).fill_null(0))
        parts = vector.flatten()
        term, w = parts.field(0), parts.field(1).to_numpy()
        text = np.repeat(np.arange(n), size)
        place = pc.index_in(term, value_set=held.terms).fill_null(-1).to_numpy()
        kth, met, n_blocks = few.column(8).to_numpy(), place >= 0, len(held.blocks)
        lists, of = held.lists(place[met])
        asks, block, weight = text[met][of], held.block[lists], w[met][of]
        own = (held.blocks[block] == few.column(3).to_numpy()[asks]) if n_blocks else np.zeros(0, bool)
        sums = held.sums(asks[own], lists[own], weight[own], n).astype(float)
        if not own.all():
            read = _best(sums, k)[1]
            kth = np.maximum(kth, read[:, -1]) if read.shape[1] == k else kth
            # the most that any passage of each block can reach
            bound = np.bincount(asks * n_blocks + block, weight * held.most[lists], n * n_blocks).reshape(n, -1)
            more = ~own & (bound >= kth[:, None] - ROOM)[asks, block]
            sums += held.sums(asks[more], lists[more], weight[more], n)
        best, found = _best(sums, k)
        kept = found > 0
        offsets = pa.array(np.concatenate(([0], np.cumsum(kept.sum(axis=1)))).astype(np.int32))
        hits = pa.StructArray.from_arrays([pa.array(found[kept]), held.ids.take(pa.array(best[kept]))], ["sim", "kb_id"])
        out = [few.column(7), pa.array(np.full(n, group, np.int32)), pa.ListArray.from_arrays(offsets, hits)]
        if first_round:
            reached = np.where(kept.sum(axis=1) == k, found[:, -1], 0.0)
            most, home, spread_ = (parts.field(i).to_numpy() for i in (2, 3, 4))
            open_, rest = _open_terms(text, w * most * ((spread_ > 1) | (home != group)), reached)
            counts = np.bincount(text[open_], minlength=n)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            # a text goes on with its vector only where something is open
            row = pa.array(np.where(counts > 0, np.arange(n), -1), mask=counts == 0)
            entries = pa.StructArray.from_arrays([term.filter(pa.array(open_)), pa.array(w[open_])], ["term", "w"])
            out += [pa.array(reached), pa.array(rest), pa.ListArray.from_arrays(offsets, entries), vector.take(row)]
        return pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunks, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy() for i in range(3)])
            starts = np.flatnonzero(np.append(True, (np.diff(marks, axis=1) != 0).any(axis=0)))
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                same = batch.slice(a, b - a)
                if key != tuple(marks[:2, a]):
                    key, chunks, held = tuple(marks[:2, a]), [], None
                if not marks[2, a]:
                    chunks.append(same)
                    continue
                if held is None:
                    block, term, kb_id, w = (pa.concat_arrays([c.column(i) for c in chunks]) for i in (3, 4, 5, 6))
                    held, chunks = _Group(term, kb_id, w.to_numpy(), block.to_numpy()), []
                step = max(1, SLICE_SUMS // len(held.ids))
                for at in range(0, same.num_rows, step):
                    yield answers(same.slice(at, step), held, int(key[0]))

    return met.mapInArrow(run, T.StructType(fields))


def _local_hits(texts: DataFrame, keys: Sequence[str], column: str, index: TermIndex, k: int, stop_words) -> DataFrame:
    """(keys, column, hits) from an index of checked size: every text is weighed and searched where it is read."""
    postings = index.postings.select("term", "kb_id", "w").toArrow().sort_by([("term", "ascending"), ("kb_id", "ascending")])
    shared = texts.sparkSession.sparkContext.broadcast((postings, index.dictionary.select("term", "idf").toArrow()))
    kb_type, first = index.postings.schema["kb_id"].dataType, index.first
    hit = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("kb_id", kb_type), T.StructField("sim", T.DoubleType())])
    found = texts.select(*keys, column, TX.words(F.col(column), stop_words).alias("_words"))
    source = found.select(*keys, column, TX.word_pairs(F.col("_words")).alias("_terms"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("hits", T.ArrayType(hit))])

    def answers(few: pa.RecordBatch, held: _Group, terms: pa.Array, idf: np.ndarray, fill: np.ndarray) -> pa.RecordBatch:
        n, column = few.num_rows, few.column(few.num_columns - 1)
        size = np.asarray(pc.list_value_length(column).fill_null(0))
        place = pc.index_in(column.flatten(), value_set=terms).fill_null(-1).to_numpy()
        text = np.repeat(np.arange(n), size)[place >= 0]
        cell, tf = np.unique(text * max(len(terms), 1) + place[place >= 0], return_counts=True)
        text, place = np.divmod(cell, max(len(terms), 1))
        w = tf * idf[place]
        norm = np.sqrt(np.bincount(text, w * w, n))
        w = w / norm[text]
        step = max(1, SLICE_SUMS // max(len(held.ids), 1))
        best, value, kept = (np.zeros((n, min(k, len(held.ids))), t) for t in (np.int64, float, bool))
        for at in range(0, n, step):
            to = min(n, at + step)
            a, b = np.searchsorted(text, [at, to])
            exact = held.sums(text[a:b] - at, place[a:b], w[a:b], to - at).astype(float)  # one block: one list per term
            sims = np.round(exact, 9)
            # passages without a shared term count at zero, the first ids only
            sims[(sims <= 0) & ~fill] = -1.0
            every = np.arange(to - at)
            for i in range(best.shape[1]):
                best[at:to, i] = top = sims.argmax(axis=1)
                kept[at:to, i] = sims[every, top] >= 0
                value[at:to, i] = exact[every, top]
                sims[every, top] = -1.0
        offsets = pa.array(np.concatenate(([0], np.cumsum(kept.sum(axis=1)))).astype(np.int32))
        rank = np.broadcast_to(np.arange(1, best.shape[1] + 1, dtype=np.int32), best.shape)
        hits = pa.StructArray.from_arrays([pa.array(rank[kept]), held.ids.take(pa.array(best[kept])), pa.array(value[kept])], ["rank", "kb_id", "sim"])
        return pa.RecordBatch.from_arrays([*few.columns[:-1], pa.ListArray.from_arrays(offsets, hits)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, dictionary = shared.value
        term, kb_id, w = (postings.column(i).combine_chunks() for i in range(3))
        held = _Group(term, kb_id, w.to_numpy(), np.zeros(len(w), np.int32), pa.array(first, kb_id.type))
        fill = np.asarray(pc.is_in(held.ids, value_set=pa.array(first, kb_id.type)))
        # all terms of the dictionary have postings, and both come in the order of the block's terms
        idf = dictionary.column(1).to_numpy()[pc.index_in(held.terms, value_set=dictionary.column(0).combine_chunks()).to_numpy()]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield answers(batch.slice(at, 4096), held, held.terms, idf, fill)

    return source.mapInArrow(run, schema)


def _block_hits(texts: DataFrame, keys: Sequence[str], column: str, index: TermIndex, k: int, stop_words, head_terms: int) -> DataFrame:
    """(keys, hits): the ranked k best passages of every text, as an array of (rank, kb_id, sim).

    One plan for any size of the index beyond what may be broadcast. A text first meets the group with the largest weight of its most telling
    term, and there the block with that weight; its k-th similarity leaves few terms that could lift a passage of another group, and of
    the groups with such a term those are probed too whose largest weights add up to it. A text goes once to a group, however many
    blocks it reads there. No row is made per shared term: a task sums them and emits k hits.
    """
    spread_ = spread(texts, keys, column)
    known = _known_terms(spread_, keys, column, index, stop_words, head_terms)
    raw = F.col("tf") * F.col("idf")
    entry = F.struct("term", raw.alias("w"), "most", "best_group", "n_groups")
    vectors = known.groupBy(*keys).agg(
        F.collect_list(entry).alias("vector"),  # the terms of one text
        F.sqrt(F.sum(raw * raw)).alias("_norm"),
        F.max_by(F.struct("best_group", "best_block"), F.struct(raw * F.col("most"), "best_block")).alias("_best"),
    )
    scaled = F.transform("vector", lambda x: x.withField("w", x["w"] / F.col("_norm")))
    asked = vectors.select(
        F.struct(*keys).alias("key"), F.col("_best.best_group").alias("group"), F.col("_best.best_block").alias("block"), F.lit(0.0).alias("kth"), scaled.alias("vector")
    )
    first = materialise(_probe(index, materialise(asked, "text-vectors"), k, first_round=True), "first-groups")
    open_ = first.filter(F.size("open") > 0)
    terms = open_.select("key", F.col("group").alias("_own"), (F.col("kth") - F.col("rest") - ROOM).alias("_least"), F.inline("open"))
    groups = F.broadcast(index.group_terms) if small_enough(index.group_terms) else index.group_terms
    met = terms.join(groups, "term").filter(F.col("group") != F.col("_own")).groupBy("key", "group", "_least")
    more = met.agg(F.sum(F.col("w") * F.col("most")).alias("_bound")).filter("_bound >= _least").select("key", "group", F.lit(-1).alias("block"))
    more = more.join(open_.select("key", "kth", "vector"), "key")
    rest = _probe(index, materialise(more, "open-groups"), k, first_round=False)
    found = first.select("key", "hits").unionAll(rest.select("key", "hits")).groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    every = spread_.select(*keys, F.struct(*keys).alias("key")).distinct().join(found, "key", "left").drop("key")
    kb_type = index.postings.schema["kb_id"].dataType
    ordered = lambda sim, kb_id: F.struct((-F.round(sim, 9)).alias("o"), kb_id.cast(kb_type).alias("kb_id"), sim.alias("sim"))
    hits = F.coalesce(F.transform("hits", lambda h: ordered(h["sim"], h["kb_id"])), F.array().cast(T.ArrayType(T.StructType([
        T.StructField("o", T.DoubleType()), T.StructField("kb_id", kb_type), T.StructField("sim", T.DoubleType())]))))
    if index.first:
        ids = F.array(*(F.lit(i) for i in index.first))
        unmet = F.filter(ids, lambda i: ~F.exists(hits, lambda h: h["kb_id"] == i))
        hits = F.concat(hits, F.transform(unmet, lambda i: ordered(F.lit(0.0), i)))
    best = F.slice(F.sort_array(hits), 1, k)
    ranked = F.transform(best, lambda h, i: F.struct((i + 1).alias("rank"), h["kb_id"].alias("kb_id"), h["sim"].alias("sim")))
    return every.select(*keys, ranked.alias("hits"))


def _hits_per_text(texts, keys, column, index, k, stop_words, head_terms=HEAD_TERMS, local_postings=LOCAL_POSTINGS) -> DataFrame:
    """(keys, column, hits), by broadcast for an index of checked size, by blocks beyond; the results are the same."""
    if small_enough(index.postings, local_postings):
        return _local_hits(texts, keys, column, index, k, stop_words)
    found = _block_hits(texts, keys, column, index, k, stop_words, head_terms)
    return found.join(spread(texts, keys, column), list(keys))


def sparse_hits(
    texts: DataFrame, keys: Sequence[str], column: str, index: TermIndex, k: int = K.TOP_K, stop_words=None,
    head_terms: int = HEAD_TERMS, local_postings: int = LOCAL_POSTINGS,
) -> DataFrame:
    """Exact top-k passages of every text, as (keys, kb_id, sim, rank); no two texts share their ``keys``.

    An index of up to ``local_postings``, with its bytes checked, is broadcast; a larger one is searched by blocks.
    """
    found = _hits_per_text(texts, keys, column, index, k, stop_words, head_terms, local_postings)
    return found.select(*keys, F.inline("hits")).select(*keys, "kb_id", "sim", "rank")


def support(hits: DataFrame, keys: Sequence[str], n_docs: int, threshold: float, k: int = K.TOP_K) -> DataFrame:
    """Groundedness (mean of the top min(k, N) similarities), truth, and the ranked hits."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "kb_id", "sim")))
    grounded = F.sum("sim") / F.lit(float(min(k, n_docs)))
    return hits.groupBy(*keys).agg(
        grounded.alias("groundedness"),
        F.least(grounded / threshold, F.lit(1.0)).alias("truth"),
        ranked.alias("hits"),
    )


def score_claims(
    texts: DataFrame,
    keys: Sequence[str],
    column: str,
    index: TermIndex,
    k: int = K.TOP_K,
    threshold: float = K.SPARSE_TRUTH_AT,
    stop_words=None,
    carry: bool = False,
) -> DataFrame:
    """Groundedness and truth of each text; with an empty knowledge base truth is neutral.

    ``carry`` keeps the text itself.
    """
    if index.n_docs == 0:
        return texts.select(
            *keys,
            *([column] if carry else []),
            F.lit(0.0).alias("groundedness"),
            F.lit(K.TEXT_NEUTRAL).alias("truth"),
            F.lit(None).cast("array<struct<rank:int,kb_id:bigint,sim:double>>").alias("hits"),
        )
    found = _hits_per_text(texts, keys, column, index, k, stop_words)
    total = F.aggregate("hits", F.lit(0.0), lambda n, h: n + h["sim"])
    grounded = total / F.lit(float(min(k, index.n_docs)))
    kept = [column] if carry else []
    return found.select(*keys, *kept, grounded.alias("groundedness"), F.least(grounded / threshold, F.lit(1.0)).alias("truth"), "hits")


def score_once(texts: DataFrame, row_id: Sequence[str], column: str, scorer, settings: str = "") -> DataFrame:
    """Score each distinct text once and hand the result to all its copies.

    Copies collapse map-side before the shuffle. A text with very many copies is salted
    on the way back.
    """
    keyed = texts.withColumn("content_key", TX.content_key(F.lit(settings), F.col(column)))
    distinct = keyed.groupBy("content_key").agg(F.first(column).alias(column))
    scored = materialise(scorer(distinct, ["content_key"], column), "scored")  # measured, then joined
    return join_to_unique(keyed, scored, "content_key", row_id)


# --- dense vectors, searched in plumbline.operators.cells ----------------------------------


def normalise(c: Column) -> Column:
    """Scale an array to unit length; a zero vector stays as it is."""
    doubles = c.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x))
    # the norm is bound to a variable, or each entry would compute it anew
    scaled = lambda n: F.when(n == 0, doubles).otherwise(F.transform(doubles, lambda x: x / n))
    return F.when(doubles.isNotNull(), F.get(F.transform(F.array(norm), scaled), F.lit(0)))

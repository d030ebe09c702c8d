"""Ranked lexical search: the best documents of each item, by hybrid term- and document-at-a-time evaluation.

Documents are searched where they are read. Each slice of texts is indexed by the items' terms only; for an item
the short posting lists are summed into accumulators (term at a time), which then act as one more bounded iterator
in the document-at-a-time search over the long lists, whose documents are skipped where the bounds of all iterators
cannot lift them into the best ``k`` found so far. Only those leave a partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import running_total
from plumbline.llm.words import lower_ascii, slices, split
from plumbline.session import materialise

BEST = 50
# Texts that are indexed at once, and items that are searched for in one reading of the documents. A reading costs
# little beside the search for so many items.
INDEX_BYTES = 8 << 20
ITEM_BYTES = 4 << 20
# Lists with at most this share of a slice's documents are short.
SHORT_SHARE = 1 / 16
# Fixed values of the score.
WEIGHT, UNIT, TF, LENGTH, BASE, SLOPE = 1000, 1_000_000_000, 1000, 20, 100, 50
# ASCII characters that part terms, all but digits and letters.
PARTS = np.zeros(256, bool)
PARTS[:128] = [not chr(b).isalnum() for b in range(128)]


@dataclass(frozen=True)
class Items:
    """A block of items as sorted distinct terms and, per item, their places (``first[i]:first[i + 1]``)."""

    number: np.ndarray
    terms: list[bytes]
    first: np.ndarray
    places: np.ndarray


def parse_items(numbers: list[int], texts: list[str | None]) -> Items:
    column = pa.array(texts, pa.large_string()).cast(pa.large_binary())
    found: list[set[bytes]] = []
    for _, _, data, offsets in slices(column):
        data = lower_ascii(data)
        words, raw = split(data, offsets, PARTS), data.tobytes()
        spans = [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
        found += [set(spans[a:b]) for a, b in zip(words.first.tolist(), words.first[1:].tolist())]
    terms = sorted(set().union(*found))
    place = {t: i for i, t in enumerate(terms)}
    places = [np.array(sorted(place[t] for t in f), np.int64) for f in found]
    first = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int64)
    return Items(np.array(numbers, np.int64), terms, first, np.concatenate([*places, np.zeros(0, np.int64)]))


def postings(data: np.ndarray, offsets: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The known terms of a slice as (term, text, occurrences), sorted, and the number of all terms per text."""
    data = lower_ascii(data)
    words = split(data, offsets, PARTS)
    n = len(words.starts)
    # words and what parts them, in turn, are spans of the same bytes; only words can be known terms
    edges = np.empty(2 * n + 1, np.int64)
    edges[:-1:2], edges[1::2] = words.starts, words.ends
    edges[-1] = len(data)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    place = pc.index_in(spans, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)[::2]
    texts = len(offsets) - 1
    known = place >= 0
    keys, tf = np.unique(place[known].astype(np.int64) * texts + words.doc[known], return_counts=True)
    term, doc = np.divmod(keys, max(texts, 1))
    return term, doc, tf.astype(np.int64), np.diff(words.first)


def _columns(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(df[f"`{key}`"].cast("long").alias("id"), df[f"`{text}`"].alias("text"))


def count_terms(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and per known term the documents that hold it, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.large_binary())
        held = np.zeros(len(terms) + 2, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), INDEX_BYTES):
                term, _, _, lengths = postings(data, offsets, terms)
                held[:-2] += np.bincount(term, minlength=len(terms))
                held[-2] += (lengths > 0).sum()
                held[-1] += lengths.sum()
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["place", "n"])

    # one number per term of the block of items
    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(len(items.terms) + 2, np.int64)
    for r in rows:
        held[r["place"]] = r["n"]
    return int(held[-2]), int(held[-1]), held[:-2]


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def length_factors(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of the score that grows with a document's length, in whole numbers."""
    if len(lengths) and SLOPE * int(lengths.max()) * n_docs >= 1 << 62:
        return np.array([BASE - SLOPE + SLOPE * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    return BASE - SLOPE + (SLOPE * lengths * n_docs) // max(n_terms, 1)


class Best:
    """The best ``k`` documents of each item so far: higher scores, then smaller ids, null last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)] * n_items
        self.threshold = np.ones(n_items, np.int64)  # scores below it can't be among the best

    def add(self, item: int, score: np.ndarray, ident: np.ndarray, missing: np.ndarray) -> None:
        score, ident, missing = (np.concatenate(x) for x in zip(self.found[item], (score, ident, missing)))
        order = np.lexsort((ident, missing, -score))[: self.k]
        self.found[item] = score[order], ident[order], missing[order]
        if len(order) == self.k:
            self.threshold[item] = score[order[-1]]


@dataclass(frozen=True)
class Lists:
    """Posting lists of a slice: list ``t`` is ``first[t]:first[t + 1]``, by document, with what each adds to a score."""

    first: np.ndarray
    doc: np.ndarray
    gain: np.ndarray
    bound: np.ndarray
    n_docs: int


def index_slice(data, offsets, terms: pa.Array, weights: np.ndarray, n_docs: int, n_terms: int) -> Lists:
    term, doc, tf, lengths = postings(data, offsets, terms)
    m = length_factors(lengths, n_docs, n_terms)
    gain = weights[term] * ((UNIT * tf) // (TF * tf + LENGTH * m[doc]))
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    bound = np.zeros(len(terms), np.int64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        bound[full] = np.maximum.reduceat(gain, first[full])
    return Lists(first, doc, gain, bound, len(lengths))


def search(lists: Lists, places: np.ndarray, threshold: int, dense: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a slice whose score reaches the threshold, for one item, with their scores."""
    size = lists.first[places + 1] - lists.first[places]
    places, size = places[lists.bound[places] > 0], size[lists.bound[places] > 0]
    short = size <= max(1, int(SHORT_SHARE * lists.n_docs))
    # term at a time: the short lists become one list of documents with summed gains
    spans = [slice(lists.first[t], lists.first[t + 1]) for t in places[short]]
    if spans:
        docs, back = np.unique(np.concatenate([lists.doc[s] for s in spans]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, back, np.concatenate([lists.gain[s] for s in spans]))
    else:
        docs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # document at a time: iterators by falling bound, the accumulators among them
    long = places[~short]
    long = long[np.argsort(-lists.bound[long], kind="stable")]
    bounds = lists.bound[long]
    top = int(sums.max()) if len(sums) else 0
    rest = np.concatenate((np.cumsum(bounds[::-1])[::-1], [0]))  # what the long lists from here on can add
    if top + rest[0] < threshold:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a document in none of the leading long lists, and not among the accumulators, can't reach the threshold
    leading = int(np.searchsorted(-rest, -threshold, "right"))
    candidates, score = docs[sums + rest[0] >= threshold], sums[sums + rest[0] >= threshold]
    if leading:
        found = np.unique(np.concatenate([lists.doc[lists.first[t] : lists.first[t + 1]] for t in long[:leading]]))
        mine = np.zeros(len(found), np.int64)
        at = np.searchsorted(found, docs)
        both = np.append(found, -1)[at] == docs
        mine[at[both]] = sums[both]
        alone = ~np.isin(candidates, found)
        candidates, score = np.concatenate((found, candidates[alone])), np.concatenate((mine, score[alone]))
    for k, t in enumerate(long):
        fit = score + rest[k] >= threshold
        if not fit.all():
            candidates, score = candidates[fit], score[fit]
        if not len(candidates):
            break
        if t not in dense:  # kept for the other items: a long list holds a good share of the slice
            dense[t] = np.zeros(lists.n_docs, np.int64)
            dense[t][lists.doc[lists.first[t] : lists.first[t + 1]]] = lists.gain[lists.first[t] : lists.first[t + 1]]
        score = score + dense[t][candidates]
    fit = score >= threshold
    return candidates[fit], score[fit]


def search_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """Per partition the best ``k`` documents of each item of a block: (_item, id, score)."""
    n_docs, n_terms, held = count_terms(docs, items)
    shared = docs.sparkSession.sparkContext.broadcast((items, term_weights(held, n_docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        terms = pa.array(items.terms, pa.large_binary())
        best = Best(len(items.number), k)
        for batch in batches:
            ids = batch.column(0)
            missing = np.asarray(ids.is_null())
            ident = ids.fill_null(0).to_numpy()
            for at, _, data, offsets in slices(batch.column(1), INDEX_BYTES):
                lists, dense = index_slice(data, offsets, terms, weights, n_docs, n_terms), {}
                for i in range(len(items.number)):
                    places = items.places[items.first[i] : items.first[i + 1]]
                    found, score = search(lists, places, int(best.threshold[i]), dense)
                    if len(found):
                        best.add(i, score, ident[at + found], missing[at + found])
        for i, (score, ident, missing) in enumerate(best.found):
            if len(score):
                columns = [pa.array(np.full(len(score), items.number[i])), pa.array(ident, mask=missing), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["_item", "id", "score"])

    return docs.mapInArrow(run, "_item long, id long, score long")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    k: int = BEST,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The ``k`` documents with the highest score above 0 of each item: item_key, rank, key, score.

    Terms are runs of ASCII letters, digits and other than ASCII characters, with A-Z lower-cased, of whole texts; a
    null text has none. Counts and weights cover all documents. The documents are read twice per ``item_bytes`` of
    items, whose terms go through the driver; nothing of the documents does but counts of those terms. A partition
    emits at most ``k`` rows per item, and no group is gathered in one task.

    Equal scores go by ascending ``key``, null last; repeated documents are ranked each. Each row of ``items`` is an
    item, also with a null or repeated key; an item without terms has no rows. Further columns are ignored, and
    neither table's names can clash. Without items or documents there are no rows.
    """
    name = {"rank", "score", key} & {item_key}
    if name:
        raise ValueError(f"the items' key needs a name of its own: {name}")
    numbered = items.select(items[f"`{item_key}`"].alias("_key"), items[f"`{item_text}`"].alias("_text"))
    numbered = materialise(numbered.withColumn("_item", F.monotonically_increasing_id()), "items")
    weight = 64 + F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    placed = running_total(numbered.withColumn("_bytes", weight), ["_item"], "_bytes", "_upto")
    block = F.floor((F.col("_upto") - F.col("_bytes")) / item_bytes).cast("long")
    placed = materialise(placed.select("_item", "_key", "_text", block.alias("_block")), "item-blocks")
    last = placed.agg(F.max("_block").alias("n")).first()["n"]
    source = _columns(docs, key, text)
    found = None
    for b in range(0 if last is None else last + 1):
        rows = placed.filter(F.col("_block") == b).select("_item", "_text").collect()  # item_bytes and one item at most
        part = parse_items([r["_item"] for r in rows], [r["_text"] for r in rows])
        if part.terms:
            part = search_block(source, part, k)
            found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "_item long, id long, score long")
    order = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    keys = placed.select("_item", "_key")
    return ranked.join(keys, "_item").select(
        F.col("_key").alias(item_key), F.col("rank").cast(T.IntegerType()), F.col("id").alias(key), "score",
    )

"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max bounds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
GRAM = 3
ITEMS_PER_BLOCK = 16
ITEMS_PER_INDEX = 20_000

# Words are runs of ASCII letters and digits and of bytes beyond ASCII, in small letters.
SEPARATORS = W.separators(bytes(i for i in range(128) if not chr(i).isalnum()))


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[W.Words, np.ndarray]:
    data = W.lower_ascii(data)
    found = W.split(data, offsets, SEPARATORS)
    return found, found.hashes()


def _halves(text: str) -> tuple[str, str]:
    """Question and answer: the last line or sentence is the answer, or else the second half of the words."""
    text = text.strip()
    for mark in ("\n", "? ", "! ", ". "):
        at = text.rstrip(".!? ").rfind(mark)
        if at > 0:
            return text[: at + 1], text[at + 1 :]
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of runs of ``GRAM`` words; of all words where there are fewer."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    size = min(GRAM, len(hashes))
    return np.unique(W.window_hashes(hashes, np.arange(len(hashes) - size + 1), size, size))


@dataclass
class Index:
    """Postings of a bounded set of items. Impacts are shares of an item's score for itself."""

    ids: list
    terms: np.ndarray  # sorted
    first: np.ndarray  # postings of a term, by item
    items: np.ndarray
    impacts: np.ndarray
    rare: np.ndarray  # whether a term is essential: the others alone never reach the threshold
    block_first: np.ndarray  # of a rare term, by block of items
    blocks: np.ndarray
    block_impacts: np.ndarray
    block_rest: np.ndarray  # what the other terms may add, at most, in a block
    parts: list  # question and answer grams of each item
    span: int  # words of the longest item


def build_index(rows: list[tuple], df: dict[int, int], n_items: int, mean: float, threshold: float) -> Index:
    """An index of ``rows`` (id, text) under the statistics of all items."""
    rows = sorted(rows, key=lambda r: (str(r[0]), r[1]))
    terms, items, impacts, parts, span = [], [], [], [], 1

    def hashed(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return _split(data, np.array([0, len(data)]))[1]

    for i, (_, text) in enumerate(rows):
        words = hashed(text)
        span = max(span, len(words))
        own, tf = np.unique(words, return_counts=True)
        n = np.array([df[int(t)] for t in own.view(np.int64)], float)
        idf = np.log1p((n_items - n + 0.5) / (n + 0.5))
        gain = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
        terms.append(own)
        items.append(np.full(len(own), i))
        impacts.append(gain / gain.sum() if len(own) else gain)
        parts.append(tuple(_grams(hashed(part)) for part in _halves(text)))
    terms, items, impacts = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((terms, np.uint64), (items, np.int64), (impacts, float)))
    order = np.lexsort((items, terms))
    terms, items, impacts = terms[order], items[order], impacts[order]
    names, first = np.unique(terms, return_index=True)
    first = np.append(first, len(terms))
    length = np.diff(first)
    # the longest lists become inessential while no item could reach half the threshold by them alone
    rest, rare = np.zeros(len(rows)), np.ones(len(names), bool)
    for t in np.argsort(-length, kind="stable"):
        at = slice(first[t], first[t + 1])
        if (rest[items[at]] + impacts[at]).max(initial=0) >= threshold / 2:
            continue
        rest[items[at]] += impacts[at]
        rare[t] = False
    term_of = np.repeat(np.arange(len(names)), length)
    n_blocks = max(1, -(-len(rows) // ITEMS_PER_BLOCK))
    key = term_of * n_blocks + items // ITEMS_PER_BLOCK
    essential = rare[term_of]
    block_key, at = np.unique(key[essential], return_index=True)
    top = np.maximum.reduceat(impacts[essential], at) if len(at) else np.zeros(0)
    block_rest = np.zeros(n_blocks)
    np.maximum.at(block_rest, np.arange(len(rows)) // ITEMS_PER_BLOCK, rest)
    return Index(
        [r[0] for r in rows], names, first, items, impacts, rare,
        np.searchsorted(block_key, np.arange(len(names) + 1) * n_blocks), block_key % n_blocks, top, block_rest, parts, span,
    )


def _expand(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list in ``of``: the places of its entries, and which list they belong to."""
    n = first[of + 1] - first[of]
    source = np.repeat(np.arange(len(of)), n)
    return np.repeat(first[of] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()), source


def search(index: Index, texts: pa.Array, threshold: float, overlap: float):
    """Rows of texts and items that match: (row, item, score, question overlap, answer overlap).

    A passage is a stretch of twice the longest item's words; stretches start at every such length, so that
    every place of an item lies within one. All passages of all texts are queries. The essential terms of a
    passage give an upper bound for each block of items; only blocks that may reach the threshold are scored in
    full, and all items at or above it are verified: enough of the runs of ``GRAM`` words of both the question
    and the answer must stand in the passage.
    """
    n_blocks, best = len(index.block_rest), {}
    if not len(index.terms):
        return best
    for at, _, data, offsets in W.slices(texts):
        found, hashes = _split(data, offsets)
        place = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
        hit = np.flatnonzero(index.terms[place] == hashes)
        if not len(hit):
            continue
        doc = found.doc
        counts = np.diff(found.first)
        per_doc = counts // index.span + 1
        base = np.concatenate(([0], np.cumsum(per_doc)))
        inner = (hit - found.first[doc[hit]]) // index.span
        here = base[doc[hit]] + inner  # passage p covers stretches p and p + 1
        term = place[hit]
        rare = index.rare[term]
        essential = [here[rare] * len(index.terms) + term[rare], (here - 1)[rare & (inner > 0)] * len(index.terms) + term[rare & (inner > 0)]]
        pairs = np.unique(np.concatenate(essential))
        passage, term_at = pairs // len(index.terms), pairs % len(index.terms)
        spot, source = _expand(index.block_first, term_at)
        key, back = np.unique(passage[source] * n_blocks + index.blocks[spot], return_inverse=True)
        bound = np.bincount(back, index.block_impacts[spot], len(key)) + index.block_rest[key % n_blocks]
        for k in key[bound >= threshold - 1e-9]:
            p, block = divmod(int(k), n_blocks)
            row = int(np.searchsorted(base, p, "right")) - 1
            begin = int(found.first[row]) + (p - int(base[row])) * index.span
            end = min(begin + 2 * index.span, int(found.first[row + 1]))
            held = np.unique(place[begin:end][index.terms[place[begin:end]] == hashes[begin:end]])
            spot, _ = _expand(index.first, held)
            of = index.items[spot]
            mine = of // ITEMS_PER_BLOCK == block
            low = block * ITEMS_PER_BLOCK
            scores = np.bincount(of[mine] - low, index.impacts[spot][mine], ITEMS_PER_BLOCK)
            good = np.flatnonzero(scores >= threshold - 1e-9)
            if not len(good):
                continue
            words = hashes[begin:end]
            grams = {n: W.window_hashes(words, np.arange(max(0, len(words) - n + 1)), n, n) for n in range(1, GRAM + 1)}
            every = np.concatenate(list(grams.values()))
            for i in good + low:
                question, answer = (float(np.isin(part, every).mean()) if len(part) else 1.0 for part in index.parts[i])
                if question >= overlap and answer >= overlap:
                    new = (float(scores[i - low]), question, answer)
                    best[at + row, int(i)] = max(new, best.get((at + row, int(i)), new))
    return best


def indexes(benchmark: DataFrame, item: str, text: str, threshold: float):
    """Indexes of at most about ``ITEMS_PER_INDEX`` items each, which together hold all items.

    Document frequencies and the mean length are taken over all items. Each index is built from one bounded part.
    """
    rows = benchmark.select(F.col(item).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def words(batches):
        for batch in batches:
            for _, end, data, offsets in W.slices(batch.column(0)):
                found, hashes = _split(data, offsets)
                docs = found.doc
                key = np.unique(np.stack([docs.astype(np.uint64), hashes]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key[1].view(np.int64)), pa.array(np.ones(key.shape[1], np.int64))], names=["term", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(hashes)], pa.int64())], names=["term", "n"])

    counted = rows.select("text").mapInArrow(words, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    n_items = rows.count()
    length = counted.filter("term is null").first()
    parts = -(-n_items // ITEMS_PER_INDEX)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(max(parts, 1)))
    for i in range(parts):
        own = rows.filter(part == i)
        # the words of a bounded number of items
        terms = own.select("text").mapInArrow(words, "term long, n long").select("term").filter("term is not null").distinct()
        df = {r["term"]: r["n"] for r in counted.join(terms, "term").collect()}
        mean = max(1.0, length["n"] / n_items)
        yield build_index([(r["id"], r["text"]) for r in own.collect()], df, n_items, mean, threshold)
    counted.unpersist()


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """Every document and benchmark item whose text the document holds: ``key``, ``item``, score and overlaps.

    The score of a passage is its BM25 score against an item as a share of the item's own; all items at or above
    ``threshold`` are verified by their question and answer. Documents are read once per index, whole, without a
    shuffle. Null and empty texts match nothing, nor do items without words; repeated rows match each for itself;
    empty tables give no rows; further columns are ignored.
    """
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    kinds = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item]
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, item, item_text, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(vars(index))  # at most ITEMS_PER_INDEX items

        def run(batches, shared=shared):
            index = Index(**shared.value)
            for batch in batches:
                best = search(index, batch.column(1), threshold, overlap)
                if best:
                    found = sorted(best)
                    ids = pa.array([index.ids[i] for _, i in found])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([r for r, _ in found])), ids, *(pa.array(x) for x in zip(*(best[f] for f in found)))],
                        names=[key, item, "score", "question_overlap", "answer_overlap"],
                    )

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay. Same rules as ``find_leaks``."""
    position = docs.columns.index(text)
    for index in indexes(benchmark, item, item_text, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches, shared=shared):
            index = Index(**shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _ in search(index, batch.column(position), threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

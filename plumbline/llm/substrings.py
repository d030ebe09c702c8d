"""Substring dedup by anchors at the positions of a difference cover."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import partitions

# A perfect difference cover. For any two positions some shift below PERIOD takes both to a cover
# position, since every difference modulo PERIOD is one of two elements.
PERIOD = 7
COVER = (0, 1, 3)
CHUNK_BYTES = 12 << 20
LAST = np.iinfo(np.int64).max


class Chunk:
    """The words of a bounded set of documents."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        self.ids = pa.array(ids).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        hashes, counts = [], []
        for _, _, data, offsets in W.slices(texts):
            found = W.split(data, offsets)
            hashes.append(found.hashes())
            counts.append(np.diff(found.first))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.concatenate(([0], np.cumsum(np.concatenate(counts) if counts else [])))
        self.first = self.first.astype(np.int64)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cover positions with a full anchor after them: position, row, hash of the anchor's words."""
        size = window - PERIOD + 1
        at = W.windows(self.first, size)
        row = np.searchsorted(self.first, at, "right") - 1
        keep = np.isin((at - self.first[row]) % PERIOD, COVER)
        at, row = at[keep], row[keep]
        return at, row, W.window_hashes(self.words, at, size, 2)

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        at = W.windows(self.first, window)
        return at, np.searchsorted(self.first, at, "right") - 1

    def names(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that stand for the words of each window."""
        return W.window_hashes(self.words, at, window, 3), W.window_hashes(self.words, at, window, 4)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where each run of them starts."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    new[1:] = ~same
    return order, np.flatnonzero(new)


def _deal(bucket: np.ndarray, *columns: np.ndarray):
    """Split columns by bucket: (bucket, bytes of each column)."""
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    at = np.append(at, len(order))
    for b, lo, hi in zip(names.tolist(), at[:-1], at[1:]):
        yield (b, *(c[order[lo:hi]].tobytes() for c in columns))


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column in one array, and how many each row holds."""
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts in a document with a smaller key.

    Two equal windows share an anchor: within the first ``PERIOD`` positions both reach a cover position at the
    same shift, and the ``window - PERIOD + 1`` words from there lie within both. So only anchors at cover positions
    (3 of 7) are hashed and dealt out. An anchor that more than one document has is sent back to where it stands
    and extended to the windows around it; these are named by 128 bits and compared everywhere, and the smallest
    key of each decides. Windows are judged on the input.

    Documents are dealt into chunks of about ``CHUNK_BYTES``. A chunk sends each of its anchors and windows once,
    so a passage that a third of all documents share costs as many entries as there are chunks.

    Returns ``key``, ``n_words``, ``n_removed`` and ``text``, the kept words joined by one space. Null texts have no
    words. A null key counts as the largest. Rows with the same key are judged alike and remove nothing from each
    other. Further columns are ignored; an empty table gives no rows.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    chunks = max(partitions(spark), -(-total // CHUNK_BYTES))
    buckets = np.uint64(max(partitions(spark), chunks // 4))
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_text"), F.lit(chunks)).cast("int"))
    packed = [pa.int32(), pa.int32(), pa.binary()]

    def send_anchors(key_, table):
        _, _, hashes = Chunk(table.column("_id"), table.column("_text")).anchors(window)
        hashes = np.unique(hashes)
        out = [(b, key_[0].as_py(), h) for b, h in _deal(hashes % buckets, hashes)]
        return _table(out, ["bucket", "chunk", "hashes"], packed)

    def share_anchors(key_, table):
        hashes, counts = _column(table, "hashes", np.uint64)
        names, n = np.unique(hashes, return_counts=True)
        shared = np.isin(hashes, names[n > 1])
        of = np.repeat(np.array(table.column("chunk").to_pylist()), counts)[shared]
        return _table(list(_deal(of, hashes[shared])), ["_chunk", "hashes"], [pa.int32(), pa.binary()])

    def send_windows(key_, table, shared):
        chunk = Chunk(table.column("_id"), table.column("_text"))
        at, row, hashes = chunk.anchors(window)
        order, starts = _runs(hashes)
        here = row[order]
        several = np.minimum.reduceat(here, starts) != np.maximum.reduceat(here, starts) if len(starts) else np.zeros(0, bool)
        marked = np.zeros(len(chunk.words) + 1, np.int64)
        local = np.zeros(len(at), bool)
        local[order] = np.repeat(several, np.diff(np.append(starts, len(order))))
        marked[at[local | np.isin(hashes, _column(shared, "hashes", np.uint64)[0])] + 1] = 1
        marked = np.cumsum(marked)
        begin, row = chunk.windows(window)
        reach = marked[begin + PERIOD] > marked[begin]
        begin, row = begin[reach], row[reach]
        high, low = chunk.names(begin, window)
        order, starts = _runs(high, low)
        least = np.minimum.reduceat(chunk.ids[row][order], starts) if len(starts) else np.zeros(0, np.int64)
        high, low = high[order][starts], low[order][starts]
        out = [(b, key_[0].as_py(), *c) for b, *c in _deal(high % buckets, high, low, least)]
        return _table(out, ["bucket", "chunk", "high", "low", "least"], [*packed, pa.binary(), pa.binary()])

    def share_windows(key_, table):
        high, counts = _column(table, "high", np.uint64)
        low, least = _column(table, "low", np.uint64)[0], _column(table, "least", np.int64)[0]
        order, starts = _runs(high, low)
        smallest = np.empty(len(order), np.int64)
        if len(starts):
            smallest[order] = np.repeat(np.minimum.reduceat(least[order], starts), np.diff(np.append(starts, len(order))))
        tell = smallest < least
        of = np.repeat(np.array(table.column("chunk").to_pylist()), counts)[tell]
        return _table(
            list(_deal(of, high[tell], low[tell], smallest[tell])), ["_chunk", "high", "low", "least"],
            [pa.int32(), pa.binary(), pa.binary(), pa.binary()],
        )

    def cut(key_, table, told):
        chunk = Chunk(table.column("_id"), table.column("_text"))
        begin, row = chunk.windows(window)
        high, low = chunk.names(begin, window)
        ids = chunk.ids[row]
        other_high, other_low = _column(told, "high", np.uint64)[0], _column(told, "low", np.uint64)[0]
        order, starts = _runs(np.concatenate((high, other_high)), np.concatenate((low, other_low)))
        known = np.concatenate((ids, _column(told, "least", np.int64)[0]))
        smallest = np.empty(len(known), np.int64)
        if len(starts):
            smallest[order] = np.repeat(np.minimum.reduceat(known[order], starts), np.diff(np.append(starts, len(order))))
        hit = begin[smallest[: len(ids)] < ids]
        step = np.zeros(len(chunk.words) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + window, -1)
        removed = np.cumsum(step)[:-1] > 0
        gone = np.concatenate(([0], np.cumsum(removed)))
        out = []
        for i, whole in enumerate(table.column("_text")):
            lo, hi = chunk.first[i], chunk.first[i + 1]
            words = (whole.as_py() or "").encode().split()
            if gone[hi] > gone[lo]:
                words = [w for w, drop in zip(words, removed[lo:hi].tolist()) if not drop]
            out.append(b" ".join(words).decode())
        n = np.diff(chunk.first)
        return pa.table([table.column("_id"), pa.array(n), pa.array(gone[chunk.first[1:]] - gone[chunk.first[:-1]]), pa.array(out, pa.string())], names=["_id", "n_words", "n_removed", "text"])

    by_chunk = rows.groupBy("_chunk")
    sent = by_chunk.applyInArrow(send_anchors, "bucket int, chunk int, hashes binary")
    shared = sent.groupBy("bucket").applyInArrow(share_anchors, "_chunk int, hashes binary")
    found = by_chunk.cogroup(shared.groupBy("_chunk")).applyInArrow(send_windows, "bucket int, chunk int, high binary, low binary, least binary")
    told = found.groupBy("bucket").applyInArrow(share_windows, "_chunk int, high binary, low binary, least binary")
    kept = by_chunk.cogroup(told.groupBy("_chunk")).applyInArrow(cut, f"_id {kind}, n_words long, n_removed long, text string")
    return kept.select(F.col("_id").alias(key), "n_words", "n_removed", "text")

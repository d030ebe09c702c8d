"""Near duplicates by DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import join_checked
from plumbline.llm.components import components
from plumbline.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
# A pair of similarity 0.8 misses all bands with probability (1 - 0.8 ** 4) ** 20 = 2.6e-5.
BANDS, ROWS = 20, 4
STAR_ROUNDS = 2
TILE = 2000
SLICE_BYTES = 1 << 20


def shingles(found: W.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set of word shingles of each text: hashes in order, where each text's begin, and how often each occurs.

    A text of fewer than ``size`` words has one shingle of all its words; one without words has none.
    """
    hashes, counts = found.hashes(), np.diff(found.first)
    at = W.windows(found.first, size)
    doc = np.searchsorted(found.first, at, "right") - 1
    value = W.window_hashes(hashes, at, size, size)
    for n in range(1, size):
        row = np.flatnonzero(counts == n)
        doc = np.concatenate((doc, row))
        value = np.concatenate((value, W.window_hashes(hashes, found.first[row], n, n)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return value[at], np.searchsorted(doc[at], np.arange(len(counts) + 1)), np.diff(np.append(at, len(doc)))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """``size`` values per set; two sets agree in each with the probability of their weighted Jaccard similarity.

    The region of an element is a strip as wide as its weight along a time axis. It is cut into unit cells, the
    last one partly used; darts hit a cell at the times of a Poisson process that the cell's hash seeds, each at a
    hashed place across the strip and for a hashed coordinate. The earliest dart of each coordinate that falls
    inside the region is kept. Only darts up to a time are looked at: on average ``size * (ln size + 2)`` per set
    whatever its weight; sets with an empty coordinate look twice as far.
    """
    n = len(first) - 1
    out = np.zeros((n, size), np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    copies = np.ceil(weights).astype(np.int64)
    total = np.bincount(doc, weights, n)
    cell_doc = np.repeat(doc, copies)
    turn = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    cell = np.repeat(elements, copies) + W.mix(turn.astype(np.uint64), 21) * (turn > 0).astype(np.uint64)
    used = np.minimum(np.repeat(weights, copies) - turn, 1.0)
    limit = size * (np.log(size) + 2) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        live = todo[cell_doc]
        cells, docs, part = cell[live], cell_doc[live], used[live]
        time, turn = np.zeros(len(cells)), 0
        hits_key, hits_time, hits_value = [], [], []
        while len(cells):
            dart = W.mix(cells, 31 + turn)
            time = time - np.log(((dart >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            keep = time <= limit[docs]
            cells, docs, part, time, dart = cells[keep], docs[keep], part[keep], time[keep], dart[keep]
            place = W.mix(dart, 7)
            inside = ((place >> np.uint64(32)).astype(float) * 2.0**-32) < part
            hits_key.append((docs * size + (place & np.uint64(0xFFFFFFFF)).astype(np.int64) % size)[inside])
            hits_time.append(time[inside])
            hits_value.append(dart[inside])
            turn += 1
        key, when, value = np.concatenate(hits_key), np.concatenate(hits_time), np.concatenate(hits_value)
        order = np.lexsort((value, when, key))
        key, value = key[order], value[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        out.reshape(-1)[key[at]] = value[at]
        full = np.bincount(key[at] // size, minlength=n) == size
        todo = todo & ~full
        limit = limit * 2
    return out


def _signed(batches, weighted: bool):
    for batch in batches:
        for at, end, data, offsets in W.slices(batch.column(1), SLICE_BYTES):
            values, first, counts = shingles(W.split(data, offsets), SHINGLE)
            weights = counts.astype(float) if weighted else np.ones(len(values))
            signature = dart_signatures(values, weights, first, BANDS * ROWS).reshape(-1, BANDS, ROWS)
            bands = np.zeros(signature.shape[:2], np.uint64)
            for r in range(ROWS):
                bands = W.mix(bands * np.uint64(3) + signature[:, :, r], 41)
            bands = W.mix(bands + np.arange(BANDS, dtype=np.uint64), 43)
            sums = []
            for seed in (51, 52):  # a set's name does not depend on order
                upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(values, seed))))
                sums.append(pa.array((upto[first[1:]] - upto[first[:-1]]).view(np.int64)))
            n = np.diff(first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *sums, pa.array(n), lists], names=["id", "high", "low", "n", "bands"])


def _shingle_rows(batches):
    for batch in batches:
        for at, end, data, offsets in W.slices(batch.column(1), SLICE_BYTES):
            values, first, _ = shingles(W.split(data, offsets), SHINGLE)
            sums = []
            for seed in (51, 52):
                upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(values, seed))))
                sums.append(pa.array((upto[first[1:]] - upto[first[:-1]]).view(np.int64)))
            sets = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([*sums, pa.array(sets, pa.binary())], names=["high", "low", "shingles"])


def _similar(batches, similarity: float):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that Jaccard similarity."""
    one = sets.select(F.col("v").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("v").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(lambda batches: _similar(batches, similarity), "a long, b long")


def _links(table: pa.Table, similarity: float) -> pa.Table:
    """Links between the components in a tile of a bucket, as many as join them; all members are compared."""
    v, comp = table.column("v").to_numpy(), table.column("comp").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(name, kind="stable")
    posted, first = owner[order], np.concatenate(([0], np.cumsum(np.bincount(name))))
    at = np.concatenate(([0], np.cumsum(size)))
    names, home, members = np.unique(comp, return_inverse=True, return_counts=True)
    top = np.arange(len(names))
    out = []
    # pairs within the largest component need no test
    for x in np.flatnonzero(home != np.argmax(members)):
        own = name[at[x] : at[x + 1]]
        n = first[own + 1] - first[own]
        spot = np.repeat(first[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(posted[spot], minlength=len(sets))
        for y in np.flatnonzero((both >= similarity * (size[x] + size - both) - 1e-9) & (top[home] != top[home[x]])):
            if top[home[x]] != top[home[y]]:
                out.append((v[x], v[y]))
                top[top == top[home[y]]] = top[home[x]]
    a, b = zip(*out) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _link_open_buckets(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between components that share a bucket, from all its members.

    A bucket of more than ``TILE`` members is cut into parts, and each two parts meet in a tile of their own.
    """
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c")).filter("x < y")
    rows = placed.join(open_.select("bucket", F.ceil(F.col("c") / TILE).cast("int").alias("parts")), "bucket")
    part = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, part).alias("i"), F.greatest(p, part).alias("j")))
    rows = rows.select("bucket", "v", "comp", F.explode(tiles).alias("tile")).join(sets, "v")
    return rows.groupBy("bucket", "tile").applyInArrow(lambda table: _links(table, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """Classes of documents that are linked by a Jaccard similarity of ``similarity`` or more over word shingles.

    Documents with the same shingles are one set from the start, by a map-side aggregate, however many they are.
    Sets with an equal band of their DartMinHash signature share a bucket. In every bucket all members are first
    compared with one of them, then with another; links are verified on the whole sets and joined to components.
    Members of a bucket that are still in different components are then all compared, through an index of their
    shingles, in tiles of bounded size that give no more links than join their components. So no candidate goes
    untested unless its link would change nothing, and no group is spelled out in pairs.

    ``weighted`` lets signatures count repeats of a shingle; links are always verified on sets.

    Returns ``key``, ``class_id`` (the smallest key of the class), ``class_size`` (its documents) and ``kept``
    (whether the row has that key), one row per row of ``docs``. Null texts and texts without words are alone in a
    class. A null key comes last. Rows that share a key are documents of their own, all kept if it is the smallest.
    Further columns are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    signed = rows.mapInArrow(lambda batches: _signed(batches, weighted), f"id {kind}, high long, low long, n long, bands array<long>")
    signed = materialise(signed, "signatures")
    sets = signed.filter("n > 0").groupBy("high", "low").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("docs"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = materialise(sets.withColumn("v", F.monotonically_increasing_id()), "sets")
    entries = sets.select("v", "n", F.explode("bands").alias("bucket"))
    several = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket")
    members = materialise(join_checked(entries, materialise(several, "buckets"), "bucket", "left_semi"), "members")
    wanted = members.select("v").distinct().join(sets.select("v", "id", "high", "low"), "v")
    wanted = materialise(wanted, "wanted")
    ids = wanted.select("id").distinct()
    texts = join_checked(rows, ids.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    found = texts.mapInArrow(_shingle_rows, "high long, low long, shingles binary")
    found = join_checked(found, wanted.select("v", "high", "low"), ["high", "low"], "inner")
    found = materialise(found.groupBy("v").agg(F.first("shingles").alias("shingles")), "shingles")

    def alike(n: str, m: str):
        return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    placed = members.withColumn("comp", F.col("v"))
    links = None
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            order = F.xxhash64("v", F.lit(turn))
            lead = placed.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "v", "n", "comp")).alias("lead"))
            pairs = placed.join(lead, "bucket").select("v", "n", "comp", F.col("lead.v").alias("w"), F.col("lead.n").alias("m"), F.col("lead.comp").alias("comp2"))
            pairs = pairs.filter("comp <> comp2").filter(alike("n", "m"))
            pairs = pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
            new = verified(materialise(pairs, "pairs"), found, similarity)
        else:
            new = _link_open_buckets(placed, found, similarity)
        new = materialise(new, "links")
        links = new if links is None else links.unionByName(new)
        comps = components(links)
        placed = members.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        if turn < STAR_ROUNDS:
            placed = materialise(placed, "placed")
    named = sets.select("v", "id", "high", "low", "docs").join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    named = materialise(named, "named")
    classes = named.groupBy("comp").agg(F.min("id").alias("class_id"), F.sum("docs").alias("class_size"))
    named = named.join(classes, "comp").select("high", "low", "class_id", "class_size")
    with_class = join_checked(signed.filter("n > 0").select("id", "high", "low"), materialise(named, "classes"), ["high", "low"], "inner")
    alone = signed.filter("n = 0").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    every = with_class.select("id", "class_id", "class_size").unionByName(alone)
    return every.select(F.col("id").alias(key), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))

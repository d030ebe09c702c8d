"""Dense search by cells: an inverted file of coarse centroids with a radius for each.

Every vector is stored with its nearest centroid. A query meets the cell with the best bound first; its k-th best
similarity there then excludes all cells whose bound, ``q.c + |q| r``, stays below (Cauchy and Schwarz), and only
the rest is probed. Large cells are cut into parts of bounded size. Vectors are shuffled in bundles of parts, and a
query goes once to each bundle that holds a part it probes, however many of them: the task knows which by their bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import constants as K
from plumbline.operators.skew import small_enough
from plumbline.session import materialise

# Vectors of a part, and queries of a slice that are multiplied with it at once.
PASSAGE_ROWS = 8_192
QUERY_ROWS = 65_536
# Vectors of the parts that a task holds together, and of the queries that share one copy of them.
BUNDLE_BYTES = 16 << 20
# Fewer queries than this are not worth another copy of a bundle.
LEAST_QUERIES = 1_024
# Hits of a slice that are held before all but the k best of each query go.
HELD_HITS = 1_000_000
# Bounds of what the driver fits and ships: vectors of the sample, bytes of it and of the centroids, cells.
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 32 << 20
MOST_CELLS = 4_096
ROUNDS = 8
# Similarities of a slice of queries that are held at once.
SLICE_SIMS = 4_000_000
# Similarities are compared at nine digits, so bounds leave room for rounding.
ROOM = 1e-8
RECALL = 0.95
RECALL_SAMPLE = 200


@dataclass(frozen=True)
class Cells:
    """An inverted file: vectors by part, and what is known of each cell."""

    vectors: DataFrame  # kb_id, v, part
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    first: np.ndarray  # parts of cell c are numbered first[c] up to first[c + 1]
    bundle: int  # parts of a bundle, which follow each other

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that a vector of each cell can score with each query; empty cells come last."""
        most = q @ self.centroids.T + np.linalg.norm(q, axis=1)[:, None] * self.radius
        return np.where(self.rows > 0, most, -np.inf)


def usable(df: DataFrame, ident: str, dim: int) -> DataFrame:
    """Rows whose vector has that many entries and no null or non-finite one."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col("v").cast("array<double>")
    return df.select(ident, v.alias("v")).filter((F.size("v") == dim) & ~F.exists("v", bad))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays of doubles as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds on a sample; the first centroids are spread evenly over it."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(42)
    centroids = distinct[np.sort(rng.permutation(len(distinct))[:cells])]
    for _ in range(ROUNDS):
        near = nearest(sample, centroids)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest(v: np.ndarray, centroids: np.ndarray, rows: int = 1024) -> np.ndarray:
    norms = (centroids**2).sum(axis=1)
    found = [np.argmin(norms - 2 * (v[at : at + rows] @ centroids.T), axis=1) for at in range(0, len(v), rows)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _side(cores: int) -> int:
    """Into how many pieces both sides are dealt at least, so that pairs of pieces fill the cores twice."""
    return math.ceil(math.sqrt(2 * cores))


def build_cells(kb: DataFrame, passage_rows: int = PASSAGE_ROWS) -> Cells | None:
    """Index ``(kb_id, v)``: every row, with centroids fitted on a bounded sample; None without vectors.

    Vectors that are null, hold null or non-finite entries, or are shorter than the longest go.
    """
    sizes = kb.filter(F.size("v") > 0).groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    longest = sizes.orderBy(F.col("dim").desc()).first()
    if longest is None:
        return None
    dim, n = longest["dim"], longest["n"]
    kb = usable(kb, "kb_id", dim)
    order = F.xxhash64("kb_id", "v")  # any fixed choice: results do not depend on the cells
    rows = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim))
    sample = np.array([r["v"] for r in kb.orderBy(order, "kb_id").limit(max(rows, 1)).select("v").collect()])
    if not len(sample):
        return None
    cells = min(math.ceil(n / passage_rows), MOST_CELLS, max(1, len(sample) // 4))
    centroids = fit_centroids(sample, cells)
    shared = kb.sparkSession.sparkContext.broadcast(centroids)  # no larger than the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                cell = nearest(v, shared.value)
                away = np.linalg.norm(v - shared.value[cell], axis=1)
                columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)]
                yield pa.RecordBatch.from_arrays(columns, ["kb_id", "v", "cell", "away"])

    schema = T.StructType([*kb.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    placed = materialise(kb.mapInArrow(place, schema), "cells")
    size, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect():  # one row per cell
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    first = np.concatenate(([0], np.cumsum(np.maximum(-(-size // passage_rows), 1))))
    table = kb.sparkSession.createDataFrame(
        [(c, int(a), int(b - a)) for c, (a, b) in enumerate(zip(first, first[1:]))], "cell int, _first int, _parts int"
    )
    part = F.col("_first") + F.pmod(F.xxhash64("kb_id", "v"), F.col("_parts")).cast("int")
    stored = placed.join(F.broadcast(table), "cell")  # one row per cell
    most = max(1, BUNDLE_BYTES // (8 * dim * passage_rows))
    bundle = min(most, math.ceil(int(first[-1]) / _side(kb.sparkSession.sparkContext.defaultParallelism)))
    return Cells(stored.select("kb_id", "v", part.alias("part")), centroids, radius, size, first, bundle)


def _route(index: Cells, queries: DataFrame, choose) -> DataFrame:
    """Add ``cells``, the bits of those that ``choose`` picks by their bounds and the k-th similarities known so far, the
    ``bundles`` that hold their parts, and ``parts``, which is not stored but read off the bits where it is asked for."""
    bare = queries.sparkSession.sparkContext.broadcast(replace(index, vectors=None))
    names = ["_q", "q_id", "v", "_kth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = bare.value
        starts = np.arange(0, cells.first[-1], cells.bundle)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                few = batch.slice(at, 1024)
                mask = choose(cells, cells.bounds(matrix(few.column(2))), few.column(3).to_numpy()) & (cells.rows > 0)
                bits = np.packbits(mask, axis=1)
                ends = np.arange(len(bits) + 1, dtype=np.int32) * bits.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bits.tobytes())])
                met = np.logical_or.reduceat(np.repeat(mask, np.diff(cells.first), axis=1), starts, axis=1)
                offsets = np.concatenate(([0], np.cumsum(met.sum(axis=1)))).astype(np.int32)
                picked = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(met)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*few.columns, packed, picked], [*names, "cells", "bundles"])

    added = [T.StructField("cells", T.BinaryType()), T.StructField("bundles", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*(queries.schema[c] for c in names), *added])
    routed = materialise(queries.select(*names).mapInArrow(run, schema), "routes")

    @F.pandas_udf("array<int>")
    def parts(bits: pd.Series) -> pd.Series:
        of = np.repeat(np.arange(len(bare.value.rows)), np.diff(bare.value.first))
        return bits.map(lambda b: np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), count=len(bare.value.rows))[of]).astype(np.int32))

    return routed.withColumn("parts", parts("cells"))


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest entries of each row, the leftmost of equals first."""
    k = min(k, sims.shape[1])
    if k > 16:
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return best, np.take_along_axis(sims, best, axis=1)
    sims, every = sims.copy(), np.arange(len(sims))
    best, found = np.empty((len(sims), k), np.int64), np.empty((len(sims), k))
    for i in range(k):
        best[:, i] = at = sims.argmax(axis=1)
        found[:, i] = sims[every, at]
        sims[every, at] = -np.inf
    return best, found


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the ids of both sides, the same for equal ones; a null id of the left equals none."""
    codes = pa.chunked_array([a, b.cast(a.type)]).combine_chunks().dictionary_encode().indices
    left, right = codes[: len(a)].fill_null(-1), codes[len(a) :].fill_null(-2)
    return left.to_numpy(), right.to_numpy()


class _Bundle:
    """The vectors of a bundle in a task, in the order of their ids, and the rows of each of its parts."""

    def __init__(self, ids: pa.Array, v: np.ndarray, part: np.ndarray, first: np.ndarray):
        self.ids, self.part = ids, part
        order = np.argsort(part, kind="stable")  # a part's rows keep the order of ids
        starts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
        rows = np.split(order, starts[1:])
        cells = np.searchsorted(first, part[order[starts]], "right") - 1
        self.parts = [(int(c), r, np.ascontiguousarray(v[r])) for c, r in zip(cells, rows)]
        self.largest = max(map(len, rows))


def _kept(hits: list[tuple], k: int) -> tuple:
    """The k best of (query, place, rounded, exact) for each query; of equals the first places, which go by the id."""
    columns = [np.concatenate(x) for x in zip(*hits)]
    order = np.lexsort((columns[1], -columns[2], columns[0]))
    query = columns[0][order]
    order = order[np.arange(len(query)) - np.searchsorted(query, query, "left") < k]
    return tuple(x[order] for x in columns)


def _probe(index: Cells, routed: DataFrame, k: int, exclude_self: bool, query_rows: int) -> DataFrame:
    """The k best vectors of each bundle among the probed parts, for each query: (_q, q_id, kb_id, part, sim).

    A bundle's vectors come first in its task, and its queries then stream past them. Queries of a bundle are dealt
    into blocks of about as many bytes as it has, each with a copy of it, so that both sides are copied about as often
    as the other has bundles.
    """
    spark, dim = routed.sparkSession, index.centroids.shape[1]
    width = 8 * dim + len(index.centroids) // 8
    asked = routed.select("_q", "q_id", "v", "_kth", "cells", F.explode("bundles").alias("bundle"))
    side = _side(spark.sparkContext.defaultParallelism)
    first, tasks = {}, 0
    for r in asked.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per bundle
        blocks = max(math.ceil(r["n"] * width / BUNDLE_BYTES), min(side, math.ceil(r["n"] / LEAST_QUERIES)))
        first[r["bundle"]] = (tasks, blocks)
        tasks += blocks
    table = spark.createDataFrame([(b, *x) for b, x in first.items()], "bundle int, _first int, _blocks int")
    vectors = index.vectors.withColumn("bundle", F.expr(f"CAST(part DIV {index.bundle} AS INT)")).join(F.broadcast(table), "bundle")
    vectors = vectors.withColumn("task", F.explode(F.sequence("_first", F.col("_first") + F.col("_blocks") - 1)))
    asked = asked.join(F.broadcast(table), "bundle").withColumn("task", F.col("_first") + F.pmod(F.xxhash64("_q"), F.col("_blocks")).cast("int"))
    q_type, kb_type = routed.schema["q_id"].dataType, index.vectors.schema["kb_id"].dataType
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    both = vectors.select(
        "task", F.lit(0).alias("asks"), none("long", "_q"), none(q_type, "q_id"), none("double", "_kth"), none("binary", "cells"), "part", "kb_id", "v"
    ).unionAll(asked.select("task", F.lit(1).alias("asks"), "_q", "q_id", "_kth", "cells", none("int", "part"), none(kb_type, "kb_id"), "v"))
    # work goes by pairs and not by bytes: tasks are not merged
    met = both.repartition(max(1, min(2 * tasks, 10_000)), "task").sortWithinPartitions("task", "asks", "kb_id")
    n_cells, cell_parts = len(index.centroids), spark.sparkContext.broadcast(index.first)

    def answers(few: pa.RecordBatch, held: _Bundle) -> pa.RecordBatch:
        n, vectors = few.num_rows, matrix(few.column(8))
        bits = np.frombuffer(b"".join(few.column(5).to_pylist()), np.uint8).reshape(n, -1)
        probes = np.unpackbits(bits, axis=1, count=n_cells).astype(bool)
        kth = few.column(4).to_numpy().copy()
        codes = _codes(few.column(3), held.ids) if exclude_self else None
        none_ = np.zeros(0, np.int64)
        hits, size = [(none_, none_, np.zeros(0), np.zeros(0))], 0
        for cell, rows, v in held.parts:
            asks = np.flatnonzero(probes[:, cell])
            if not len(asks):
                continue
            exact = (vectors if len(asks) == n else vectors[asks]) @ v.T
            if codes:
                exact[codes[0][asks][:, None] == codes[1][rows][None, :]] = -np.inf
            if np.isneginf(kth[asks]).any():
                best, found = _best(np.round(exact, 9), k)
                at, column = np.nonzero(np.isfinite(found))
                column = best[at, column]
            else:
                at, column = np.nonzero(exact >= (kth[asks] - ROOM)[:, None])
            if not len(at):
                continue
            exact = exact[at, column]
            hits.append((asks[at], rows[column], np.round(exact, 9), exact))
            size += len(at)
            if size > HELD_HITS:
                hits, size = [_kept(hits, k)], 0
                # the first k - 1 of a query are no less than its k-th
                last = np.flatnonzero(np.arange(len(hits[0][0])) - np.searchsorted(hits[0][0], hits[0][0], "left") == k - 1)
                kth[hits[0][0][last]] = np.maximum(kth[hits[0][0][last]], hits[0][2][last])
        query, place, _, exact = _kept(hits, k)
        row = pa.array(query)
        out = [few.column(2).take(row), few.column(3).take(row), held.ids.take(pa.array(place)), pa.array(held.part[place]), pa.array(exact)]
        return pa.RecordBatch.from_arrays(out, ["_q", "q_id", "kb_id", "part", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunks, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy() for i in range(2)])
            starts = np.flatnonzero(np.append(True, (np.diff(marks, axis=1) != 0).any(axis=0)))
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                same = batch.slice(a, b - a)
                if task != marks[0, a]:
                    task, chunks, held = marks[0, a], [], None
                if not marks[1, a]:
                    chunks.append((same.column(7), matrix(same.column(8)), same.column(6).to_numpy()))
                elif chunks or held is not None:
                    if held is None:
                        ids, v, part = zip(*chunks)
                        held, chunks = _Bundle(pa.concat_arrays(ids), np.vstack(v), np.concatenate(part), cell_parts.value), []
                    step = max(1, min(query_rows, 8192, SLICE_SIMS // held.largest))
                    for at in range(0, same.num_rows, step):
                        yield answers(same.slice(at, step), held)

    schema = T.StructType([
        T.StructField("_q", T.LongType()), T.StructField("q_id", q_type), T.StructField("kb_id", kb_type),
        T.StructField("part", T.IntegerType()), T.StructField("sim", T.DoubleType()),
    ])
    return met.mapInArrow(run, schema)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.round("sim", 9).desc(), "kb_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _numbered(queries: DataFrame, index: Cells) -> DataFrame:
    rows = usable(queries, "q_id", index.centroids.shape[1])
    numbered = rows.withColumns({"_q": F.monotonically_increasing_id(), "_kth": F.lit(-math.inf)})
    return materialise(numbered, "queries")


def _search(index: Cells, numbered: DataFrame, k: int, exclude_self: bool, query_rows: int) -> DataFrame:
    """Exact top k in two rounds: the cells with the best bounds, then all whose bounds reach the k-th similarity."""
    needed = k + exclude_self

    def first_cells(cells: Cells, bounds: np.ndarray) -> np.ndarray:
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(cells.rows[order], axis=1) - cells.rows[order]
        mask = np.zeros(bounds.shape, bool)
        np.put_along_axis(mask, order, before < needed, axis=1)
        return mask

    first = _probe(index, _route(index, numbered, lambda c, b, kth: first_cells(c, b)), k, exclude_self, query_rows)
    first = materialise(_ranked(first, k).drop("rank"), "first-cells")
    kth = first.groupBy("_q").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("_kth"))
    known = numbered.drop("_kth").join(kth, "_q", "left").select("_q", "q_id", "v", F.coalesce("_kth", F.lit(-math.inf)).alias("_kth"))

    def open_cells(cells: Cells, bounds: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return (bounds >= kth[:, None] - ROOM) & ~first_cells(cells, bounds)

    rest = _probe(index, _route(index, known, open_cells), k, exclude_self, query_rows)
    return _ranked(first.unionByName(rest), k)


def search_cells(
    queries: DataFrame,
    kb: DataFrame,
    k: int = K.TOP_K,
    exclude_self: bool = False,
    query_rows: int = QUERY_ROWS,
    passage_rows: int = PASSAGE_ROWS,
) -> DataFrame:
    """Exact top-k passages by inner product of ``(q_id, v)`` against ``(kb_id, v)``: q_id, kb_id, sim, rank.

    Vectors are shuffled in bundles of cells, and queries once per bundle with a cell that their bound does not exclude. Equal similarities (at
    nine digits) go to the lower id; ``exclude_self`` leaves out passages with the query's own id. Rows without a
    vector of the passages' length have no hits. A query row that occurs twice is answered twice.
    """
    index = build_cells(kb, passage_rows)
    if index is None:
        return _without_hits(queries, kb)
    hits = _search(index, _numbered(queries, index), k, exclude_self, query_rows)
    return hits.select("q_id", "kb_id", "sim", "rank")


def _without_hits(queries: DataFrame, kb: DataFrame) -> DataFrame:
    found = queries.select("q_id").limit(0).crossJoin(kb.select("kb_id").limit(0))  # both empty
    return found.select("q_id", "kb_id", F.lit(0.0).alias("sim"), F.lit(0).alias("rank"))


def fit_probes(index: Cells, numbered: DataFrame, k: int, exclude_self: bool, recall: float) -> int:
    """How many cells, by falling bound, held that share of the k best of a sample of the queries."""
    sample = materialise(numbered.orderBy(F.xxhash64("_q"), "_q").limit(RECALL_SAMPLE), "query-sample")
    where = _search(index, sample, k, exclude_self, QUERY_ROWS).select("_q", "part").collect()  # k rows per sampled query
    vectors = {r["_q"]: np.array(r["v"]) for r in sample.select("_q", "v").collect()}
    ranks = []
    for r in where:
        bounds = index.bounds(vectors[r["_q"]][None, :])[0]
        cell = np.searchsorted(index.first, r["part"], "right") - 1
        ranks.append(int((bounds > bounds[cell]).sum()) + 1)
    ranks.sort()
    return ranks[min(len(ranks), math.ceil(recall * len(ranks))) - 1] if ranks else len(index.rows)


def search_cells_approximately(
    queries: DataFrame,
    kb: DataFrame,
    k: int = K.TOP_K,
    exclude_self: bool = False,
    recall: float = RECALL,
    query_rows: int = QUERY_ROWS,
    passage_rows: int = PASSAGE_ROWS,
) -> DataFrame:
    """Top-k passages among the cells with the best bounds: as many as hold ``recall`` of the k best of a sample.

    Every passage is indexed; the sample of at most ``RECALL_SAMPLE`` queries is searched exactly. Vectors without
    close neighbours need most cells, clustered ones few. Output and odd rows as for ``search_cells``.
    """
    index = build_cells(kb, passage_rows)
    if index is None:
        return _without_hits(queries, kb)
    numbered = _numbered(queries, index)
    probes = fit_probes(index, numbered, k, exclude_self, recall)

    def leading(cells: Cells, bounds: np.ndarray, kth: np.ndarray) -> np.ndarray:
        mask = np.zeros(bounds.shape, bool)
        np.put_along_axis(mask, np.argsort(-bounds, axis=1, kind="stable")[:, :probes], True, axis=1)
        return mask

    hits = _probe(index, _route(index, numbered, leading), k, exclude_self, query_rows)
    return _ranked(hits, k).select("q_id", "kb_id", "sim", "rank")

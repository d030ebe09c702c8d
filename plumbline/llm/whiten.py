"""Whitening of embeddings by spectral divide and conquer.

The covariance of the distinct vectors is gathered on executors; it has one row and column per dimension. The
driver splits its space in two again and again: the polar factor of the shifted covariance, by the QR form of the
dynamically weighted Halley iteration, gives the projector on the eigenvalues above the shift (Nakatsukasa and
Higham 2013). The components are broadcast and project all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import materialise

# How an entry becomes a whole number.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
EPS = np.finfo(float).eps
LARGEST = 1 << 62
LONG_MAX = (1 << 63) - 1


# --- the symmetric eigenproblem -----------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH steps in QR form."""
    n = len(a)
    x = a / (np.linalg.norm(a) or 1.0)
    low = EPS  # below the least singular value of all but singular matrices
    eye = np.eye(n)
    for _ in range(60):
        s = low * low
        d = np.cbrt(4 * (1 - s) / (s * s))
        root = np.sqrt(1 + d)
        weight = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - s) / (s * root), 0.0))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = (b / c) * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (weight + b * s) / (1 + c * s))
        if moved < 10 * EPS * np.sqrt(n) and 1 - low < 10 * EPS:
            break
    return x


def split_space(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift, or None where all eigenvalues are alike."""
    n = len(a)
    spread = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    low, high = (np.diag(a) - spread).min(), (np.diag(a) + spread).max()
    size = max(abs(low), abs(high))
    shift, room = float(np.median(np.diag(a))), 1e3 * EPS * n * size
    while high - low > 8 * EPS * n * size:
        u = polar_factor(a - shift * np.eye(n))
        above = round(float(np.trace(u) + n) / 2)
        projector = (u + np.eye(n)) / 2
        if 0 < above < n:
            basis = rng.normal(size=(n, above))
            for _ in range(3):
                basis, _ = np.linalg.qr(projector @ basis)
            q, _ = np.linalg.qr(basis, mode="complete")
            upper, lower = q[:, :above], q[:, above:]
            if np.linalg.norm(lower.T @ a @ upper) <= room:
                return upper, lower
            # the shift met an eigenvalue: try beside it, and take less exact bases in the end
            shift, room = shift + (high - low) * 1e-3 * (1 + rng.random()), 4 * room
            continue
        low, high = (low, shift) if above == 0 else (shift, high)
        shift = (low + high) / 2
    return None


def leading_components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    rng = np.random.default_rng(20130917)
    found: list[tuple[float, np.ndarray]] = []

    def descend(basis: np.ndarray, wanted: int) -> None:
        if wanted <= 0:
            return
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        halves = split_space(part, rng) if len(part) > 1 else None
        if halves is None:
            found.extend((float(v @ a @ v), v) for v in basis.T[:wanted])
            return
        upper, lower = halves
        descend(basis @ upper, wanted)
        descend(basis @ lower, wanted - upper.shape[1])

    if len(a):
        descend(np.eye(len(a)), min(wanted, len(a)))
    found.sort(key=lambda x: -x[0])
    values = np.array([e for e, _ in found])
    vectors = np.array([v / np.linalg.norm(v) for _, v in found]).T if found else np.zeros((len(a), 0))
    return values, vectors


# --- vectors in Arrow batches -------------------------------------------------------------


def whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a column of double arrays that hold only finite numbers, as (row numbers, whole numbers), by length.

    An entry becomes floor(64 c) + 1,000,000; what a long can't hold ends at 2^62 and -2^62.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(column).fill_null(-1))
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        entries = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
        finite = np.isfinite(entries).all(axis=1)
        c = np.clip(np.floor(SCALE * entries[finite]), -LARGEST, LARGEST)
        yield rows[finite], c.astype(np.int64) + SHIFT


def pack(x: np.ndarray) -> list[bytes]:
    """One value per vector, equal for equal vectors only: the width of the entries, then the entries less the shift."""
    y = x - SHIFT
    most = np.maximum(y.max(axis=1), -(y.min(axis=1) + 1))
    out: list[bytes] = [b""] * len(y)
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        raw = y[rows].astype(f"<i{w}").tobytes()
        step = len(raw) // len(rows)
        for k, row in enumerate(rows):
            out[row] = bytes([w]) + raw[k * step : (k + 1) * step]
    return out


def unpack(column: pa.Array, size: int) -> np.ndarray:
    values = column.to_pylist()
    width = np.fromiter((v[0] for v in values), np.int64, len(values))
    x = np.empty((len(values), size), np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        x[rows] = np.frombuffer(b"".join(values[r][1:] for r in rows), f"<i{w}").reshape(-1, size)
    return x + SHIFT


@dataclass(frozen=True)
class Whitening:
    """What all rows are whitened by; one entry per dimension, one column per component."""

    n: int
    sums: list[int]  # exact
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the sums exceed n times the centre by: at least 0, below n."""
        return np.array([s % self.n for s in self.sums], np.int64)

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > 64 * EPS * len(self.sums) * max(self.trace, 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(float) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.where(self.usable, self.values, 1.0))
        return (self.centred(x) @ self.vectors) / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; None where a long can't hold it."""
        away = self.n * (x - self.centre).astype(float) - self.rest
        about = (away * away).sum(axis=1)
        # below the bound neither the products nor their sum leave the range of a long
        safe = about < LONG_MAX * 0.99
        exact = self.n * (np.where(safe[:, None], x, self.centre) - self.centre) - self.rest
        out: list[int | None] = (exact * exact).sum(axis=1).tolist()
        for i in np.flatnonzero(~safe):
            total = None
            if about[i] < LONG_MAX * 1.01:
                total = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums))
            out[i] = total if total is not None and total <= LONG_MAX else None
        return out


def _sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows and exact sums of a partition, each sum in two halves that can't overflow."""
    n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        x = unpack(batch.column(0), size)
        n += len(x)
        high += (x >> 32).sum(axis=0)
        low += (x & 0xFFFFFFFF).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])


def _summed_products(df: DataFrame, size: int, project) -> np.ndarray:
    """The sum of the outer products of ``project`` of all vectors, and below it their plain sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            w = project(unpack(batch.column(0), size))
            part = np.vstack([w.T @ w, w.sum(axis=0)])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    parts = df.mapInArrow(run, "i long, j long, v double")
    # one number for each pair of dimensions
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    width = max((r["j"] for r in rows), default=-1) + 1
    out = np.zeros((width + 1, width))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def fit_whitening(vectors: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct vector once; None without any."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                dims = pa.array(np.full(len(x), x.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(pack(x), pa.binary()), dims], ["x", "dims"])

    source = vectors.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    # equal vectors meet map-side first, so copies cost no shuffle
    distinct = materialise(source.mapInArrow(packed, "x binary, dims int").distinct(), "distinct-vectors")
    sizes = distinct.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc())
    first = sizes.first()
    if first is None:
        return None
    size = first["dims"]
    fit = distinct.filter(F.col("dims") == size).select("x")
    whole = T.DecimalType(38, 0)
    sums = (
        fit.mapInArrow(lambda b: _sums(b, size), "i long, n long, high long, low long")
        .groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low"))
        .orderBy("i").collect()
    )  # one row per dimension
    n = sums[0]["n"]
    model = Whitening(n, [(int(r["high"]) << 32) + int(r["low"]) for r in sums], np.zeros(0), np.zeros((size, 0)), 0.0)
    products = _summed_products(fit, size, model.centred)
    mean = products[size] / n  # rounding only, for the rows were centred
    covariance = products[:size] / n - np.outer(mean, mean)
    values, basis = leading_components((covariance + covariance.T) / 2, components)
    model = Whitening(n, model.sums, values, basis, float(np.trace(covariance)))
    used = np.flatnonzero(model.usable)
    error = None
    if len(used):
        checked = _summed_products(fit, size, lambda x: model.whitened(x)[:, used])
        mean = checked[-1] / n
        error = float(np.abs(checked[:-1] / n - np.outer(mean, mean) - np.eye(len(used))).max())
    return Whitening(n, model.sums, values, basis, model.trace, error)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Centre, project and scale every vector: one row per vector and component.

    Vectors that are null, empty, or hold null or non-finite entries go. Entries become floor(64 c) + 1,000,000.
    The fit counts each distinct vector once. Where lengths differ, the length with most distinct vectors is fitted
    (of several the longest) and vectors of other lengths go. The driver gets sums over all vectors only: one number
    per dimension and per pair of dimensions.

    Returns ``key``, ``component`` (from 1, by falling variance, at most ``components``), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``. ``deviation`` is null where a long can't hold it;
    ``whitened`` is null for a component without variance, ``explained`` where nothing varies. Repeated rows and null
    keys give rows of their own; further columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    fitted = fit_whitening(df, vector, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fitted)  # one row per dimension, at most ``components`` columns

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size, k = model.vectors.shape
        explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            for rows, x in whole_numbers(batch.column(1)):
                if x.shape[1] != size or not len(rows):
                    continue
                w = model.whitened(x)
                lost = np.broadcast_to(~model.usable, w.shape)
                m = len(rows)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows[each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(w.ravel(), mask=lost.ravel()),
                        pa.array(np.tile(explained, m), mask=np.tile(np.isnan(explained), m)),
                        pa.array([model.identity_error] * (m * k), pa.float64()),
                    ],
                    names=schema.names,
                )

    source = df.select(F.col(f"`{key}`"), F.col(f"`{vector}`").cast("array<double>"))
    return source.mapInArrow(project, schema)

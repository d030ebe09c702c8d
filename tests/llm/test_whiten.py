"""Whitening against numpy's eigenvectors, and its odd rows."""

import math

import numpy as np
import pytest

from plumbline.llm import whiten as W
from plumbline.llm.queries import op12_whitened_embeddings


def brute(vectors, components):
    """Whole numbers, fit and projections in plain numpy."""
    kept = {i: [math.floor(64 * float(np.float64(c))) + 1_000_000 for c in v] for i, v in vectors.items()
            if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, kept.values()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums).astype(float) / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    out = {}
    for i, x in kept.items():
        away = n * np.array(x, dtype=object) - sums
        white = (away.astype(float) / n) @ basis / np.sqrt(values)
        out[i] = (int((away * away).sum()), white)
    return n, out, values / np.trace(cov)


def check(rows, n, want, explained, components):
    assert len(rows) == len(want) * components
    signs = {}
    for r in rows:
        deviation, white = want[r.vec_id]
        k = r.component - 1
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained[k], rel=1e-9)
        if abs(white[k]) > 1e-3:
            signs.setdefault(k, np.sign(white[k] * r.whitened))
        assert r.whitened == pytest.approx(signs.get(k, 1) * white[k], abs=1e-6)
        assert 0 <= r.identity_error < 1e-9


def test_query_against_numpy(spark):
    folder = "/root/testdata/sf0.01"
    vectors = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    n, want, explained = brute(vectors, 16)
    check(op12_whitened_embeddings(spark, folder).collect(), n, want, explained, 16)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = {i: rng.normal(size=4).tolist() for i in range(40)}
    good |= {100 + i: good[0] for i in range(60)}  # one vector holds more than half of all rows
    bad = {200: None, 201: [], 202: [1.0, None, 2.0, 3.0], 203: [math.nan] * 4, 204: [math.inf, 0.0, 0.0, 0.0], 205: [1.0, 2.0]}
    rows = [(i, v, "x") for i, v in (good | bad).items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    n, want, explained = brute(good, 16)
    assert n == 40
    check(W.whiten(df).collect(), n, want, explained, 4)
    again = W.whiten(df.unionAll(df))
    assert again.count() == 2 * 4 * len(good)


def test_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    empty = W.whiten(spark.createDataFrame([], schema))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = W.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all((r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (None, 1, 0, None, None, None) for r in one)
    # the second dimension stands still: its component has no variance
    flat = W.whiten(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(10)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-12


def test_deviation_beyond_a_long(spark):
    rows = [(0, [3e38]), (1, [-3e38]), (2, [0.0])]
    got = {r.vec_id: r for r in W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0].deviation is None and got[0].whitened == pytest.approx(-got[1].whitened, rel=1e-9)
    edge = 2**31 // 2 - 5  # (n x - S)^2 just within a long
    near = W.whiten(spark.createDataFrame([(0, [edge / 32.0]), (1, [-edge / 32.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in near} == {(4 * edge) ** 2 if (4 * edge) ** 2 < 2**63 else None}


@pytest.mark.parametrize("kind", ["random", "clusters", "steep", "ones", "zero", "repeated diagonal"])
def test_components_of_matrices(kind):
    rng = np.random.default_rng(8)
    d = 48
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = {
        "random": rng.uniform(1, 100, d), "clusters": np.repeat([5.0, 5.0 + 1e-9, 1.0], 16), "steep": 10.0 ** -np.arange(d),
        "ones": np.ones(d), "zero": np.zeros(d), "repeated diagonal": np.repeat([2.0, 1.0], 24),
    }[kind]
    a = np.diag(values) if kind == "repeated diagonal" else q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    e, v = W.leading_components(a, 16)
    want = np.sort(values)[::-1][:16]
    scale = max(want[0], 1e-300)
    assert np.abs(e - want).max() <= 1e-13 * scale and np.abs(v.T @ v - np.eye(16)).max() < 1e-13
    assert np.abs(a @ v - v * e).max() <= 1e-12 * scale


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    signs = np.sign(rng.normal(size=30))
    a = q @ np.diag(signs * rng.uniform(1e-9, 10, 30)) @ q.T
    assert np.abs(W.polar_factor((a + a.T) / 2) - q @ np.diag(signs) @ q.T).max() < 1e-6


def test_packing_is_one_to_one():
    import pyarrow as pa

    x = np.array([[1_000_000, 1_000_127], [999_872, 1_000_000], [1_000_128, 1_000_000], [1_040_000, 0], [1 << 40, -(1 << 61)]])
    packed = W.pack(x)
    assert len(set(packed)) == 5 and (W.unpack(pa.array(packed, pa.binary()), 2) == x).all()

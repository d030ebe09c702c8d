"""Grouped logistic fits against Newton's method in numpy, group by group."""

import numpy as np
import pytest

from plumbline.operators import grouped


def fit(x, y, penalty=1.0):
    """Damped Newton steps of one group."""
    x = np.hstack([np.ones((len(x), 1)), x])
    shrink = np.array([0.0] + [penalty] * (x.shape[1] - 1))
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * (shrink * w**2).sum()
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(np.maximum(shrink, 1e-12)), x.T @ (p - y) + shrink * w)
        size = 1.0
        while loss(w - size * step) > loss(w) + 1e-12 and size > 1e-9:
            size /= 2
        w = w - size * step
    return w


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    out = []
    for g, n in [(0, 400), (1, 30), (2, 12), (3, 6), (None, 25), (5, 8), (6, 1)]:
        x = rng.normal(size=(n, 3)) * [1, 20, 0.1]
        y = (x @ [1.5, 0.05, 2.0] + rng.normal(size=n) > 0.3).astype(int)
        if g == 5:
            y[:] = 1  # one label only
        if g == 2:
            y = (x[:, 1] > 0).astype(int)  # separable
        out += [(i + 1000 * (9 if g is None else g), g, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    return out


NAMES = "id long, g int, a double, b double, c double, y int"


def test_coefficients(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, NAMES).repartition(4)
    got = {r.g: np.array(r.coefficients) for r in grouped.fit_logistic(df, ["g"], ["a", "b", "c"], "y").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        part = np.array([r[2:] for r in rows if r[1] == g], float)
        if len(set(part[:, 3])) == 2:
            want[g] = fit(part[:, :3], part[:, 3])
    assert set(got) == set(want) and 5 not in got and 6 not in got and None in got
    for g, w in want.items():
        assert got[g] == pytest.approx(w, rel=1e-6, abs=1e-6)


def test_wild_scales_still_converge(spark):
    """Steps that overshoot are halved."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=30) * 1e3, [1e6, -1e6]])
    y = (x + rng.normal(size=32) * 500 > 0).astype(int)
    df = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(x, y)], "g int, x double, y int")
    w = np.array(grouped.fit_logistic(df, ["g"], ["x"], "y", steps=100).first().coefficients)
    p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
    assert abs((p - y).sum()) < 1e-6 and abs(((p - y) * x).sum() + w[1]) < 1e-3


def test_odd_values_and_empty_tables(spark):
    bad = [(1, None, 1), (1, float("nan"), 0), (1, float("inf"), 1), (1, 2.0, None), (1, 3.0, 0), (1, 1.0, 1)]
    plain = [(1, 0.0, 1), (1, 0.0, 0), (1, 0.0, 1), (1, 3.0, 0), (1, 1.0, 1)]
    a, b = (spark.createDataFrame(r, "g int, x double, y int") for r in (bad, plain))
    one, two = (np.array(grouped.fit_logistic(df, ["g"], ["x"], "y").first().coefficients) for df in (a, b))
    assert one == pytest.approx(two)
    assert grouped.fit_logistic(a.limit(0), ["g"], ["x"], "y").count() == 0


def test_gaps_of_datasets(spark, rows):
    df = spark.createDataFrame([(*r, "u" if r[0] % 3 else "v") for r in rows], NAMES + ", s string")
    got = {r.g: r for r in grouped.fitted_gaps(df, ["g"], ["a", "b", "c"], "y", "s", "u", "v", ["id"]).collect()}
    assert len(got) == 7
    for g, r in got.items():
        part = [x for x in rows if x[1] == g]
        assert r.n == len(part)
        if r.coefficients is None:
            assert (r.demographic_parity, r.equal_opportunity, r.bias_score) == (0, 0, 0)
            continue
        w = np.array(r.coefficients)
        pred = [(x[0] % 3 != 0, x[5], w[0] + np.dot(w[1:], x[2:5]) > 0) for x in part]
        rate = lambda rows: np.mean([p for p in rows]) if rows else 0.0
        parity = abs(rate([p for u, _, p in pred if u]) - rate([p for u, _, p in pred if not u]))
        tpr = abs(rate([p for u, y, p in pred if u and y]) - rate([p for u, y, p in pred if not u and y]))
        assert (r.demographic_parity, r.equal_opportunity) == (pytest.approx(parity), pytest.approx(tpr))


def test_small_groups_are_fitted_without_steps_over_all_rows(spark, monkeypatch):
    """Small groups take one task each and give what the steps over large ones give; a group of null is one too."""
    rng, joined = np.random.default_rng(3), []
    rows = [(None if g == 0 else g, float(a), float(b), int(rng.random() < 1 / (1 + np.exp(-a)))) for g in range(40) for a, b in rng.normal(size=(6 + g, 2))]
    rows += [(99, 1.0, 2.0, 1)] * 3 + [(98, None, float("inf"), i % 2) for i in range(4)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y int")
    join = grouped.join_to_unique
    monkeypatch.setattr(grouped, "join_to_unique", lambda *a: joined.append(1) or join(*a))
    fits = []
    for small in (grouped.SMALL_ROWS, 0, 20):
        monkeypatch.setattr(grouped, "SMALL_ROWS", small)
        fits.append({r.g: r.coefficients for r in grouped.fit_logistic(df, ["g"], ["a", "b"], "y").collect()})
        assert bool(joined) == (small < 256)
    for other in fits[1:]:
        assert fits[0].keys() == other.keys() and 99 not in other and 98 in other
        assert all(np.allclose(fits[0][g], other[g], atol=1e-8) for g in other)

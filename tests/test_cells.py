"""Dense search by cells against all pairs in numpy."""

import numpy as np
import pytest

from plumbline.operators import cells


def table(spark, ident, vectors):
    return spark.createDataFrame([(i, v) for i, v in vectors], f"{ident} long, v array<double>").repartition(3)


def brute(queries, kb, k, exclude_self):
    out = []
    for q, a in queries:
        scored = sorted((-round(float(np.dot(a, b)), 9), i) for i, b in kb if not (exclude_self and i == q))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted((r.q_id, r.kb_id, round(r.sim, 9), r["rank"]) for r in df.collect())


def clustered(rng, n, centres=12, dim=16):
    middle = rng.normal(size=(centres, dim)) * 4
    v = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.05
    return [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("sizes", [{"passage_rows": 8}, {"passage_rows": 40, "query_rows": 7}, {}])
def test_exact_search(spark, exclude_self, sizes):
    rng = np.random.default_rng(1)
    kb = clustered(rng, 300)
    kb += [(1000 + i, kb[0][1]) for i in range(150)]  # one vector holds a third of all rows
    kb.append((2000, [3 * x for x in kb[7][1]]))  # not of unit length
    queries = kb[::9] + [(5000, [0.0] * 16)]
    got = cells.search_cells(table(spark, "q_id", queries), table(spark, "kb_id", kb), 3, exclude_self, **sizes)
    assert rows(got) == brute(queries, kb, 3, exclude_self)


def test_bounds_exclude_cells(spark, monkeypatch):
    """In clustered vectors a query meets few cells, and still finds the exact neighbours."""
    rng = np.random.default_rng(2)
    kb, routes = clustered(rng, 600, centres=30), []
    route = cells._route
    monkeypatch.setattr(cells, "_route", lambda *a: routes.append(route(*a)) or routes[-1])
    got = cells.search_cells(table(spark, "q_id", kb[:100]), table(spark, "kb_id", kb), 3, passage_rows=20)
    assert rows(got) == brute(kb[:100], kb, 3, False)
    probed = sum(len(r["parts"]) for df in routes for r in df.collect())
    assert probed < 0.4 * 100 * 30


def test_approximate_search(spark):
    rng = np.random.default_rng(3)
    kb = clustered(rng, 800, centres=40)
    queries = kb[::20]
    exact = {r[:2] for r in brute(queries, kb, 3, True)}
    got = rows(cells.search_cells_approximately(table(spark, "q_id", queries), table(spark, "kb_id", kb), 3, True, passage_rows=20))
    assert len({r[:2] for r in got} & exact) >= 0.9 * len(exact) and all(q != i for q, i, *_ in got)


@pytest.mark.parametrize("search", [cells.search_cells, cells.search_cells_approximately])
def test_odd_rows(spark, search):
    kb = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 0.0]), (None, [0.5, 0.5]), (8, [0.0, 1.0])]
    queries = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (3, None), (4, [1.0, 0.0, 0.0])]
    got = search(table(spark, "q_id", queries), table(spark, "kb_id", kb), 2, True).collect()
    assert sorted(((r.q_id or 0), (r.kb_id or 0), r.sim, r["rank"]) for r in got) == [
        (0, 0, 0.5, 2), (0, 8, 1.0, 1), (1, 0, 0.5, 1), (1, 0, 0.5, 1), (1, 8, 0.0, 2), (1, 8, 0.0, 2)]
    few, none = table(spark, "q_id", queries), table(spark, "kb_id", kb).filter("kb_id = 3")
    for q, p in ((few, none), (few.limit(0), table(spark, "kb_id", kb)), (few, none.limit(0))):
        out = search(q, p)
        assert out.columns == ["q_id", "kb_id", "sim", "rank"] and out.count() == 0


def test_text_ids(spark):
    kb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "kb_id string, v array<double>")
    got = cells.search_cells(kb.withColumnRenamed("kb_id", "q_id"), kb, 1, exclude_self=True).collect()
    assert {r.q_id: r.kb_id for r in got} == {"a": "b", "b": "a", "c": "b"}


def test_queries_are_copied_by_bundles_and_not_by_parts(spark, monkeypatch):
    """Without near neighbours a query probes nearly all small parts, and still goes to few tasks."""
    rng = np.random.default_rng(4)
    kb, routes = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(900, 16)))], []
    route = cells._route
    monkeypatch.setattr(cells, "_route", lambda *a: routes.append(route(*a)) or routes[-1])
    monkeypatch.setattr(cells, "HELD_HITS", 50)
    got = cells.search_cells(table(spark, "q_id", kb[:90]), table(spark, "kb_id", kb), 3, True, query_rows=20, passage_rows=5)
    assert rows(got) == brute(kb[:90], kb, 3, True)
    probed = [(len(r["parts"]), len(r["bundles"])) for df in routes for r in df.collect()]
    assert sum(p for p, _ in probed) > 90 * 100 and max(b for _, b in probed) <= cells._side(spark.sparkContext.defaultParallelism)

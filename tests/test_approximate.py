"""Approximate neighbours against the exact search."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cells
from plumbline.operators import retrieval as R
from plumbline.plans import REGISTRY


@pytest.mark.parametrize("blocks", [{}, {"query_rows": 60, "passage_rows": 50}])
def test_recall_of_approximate_neighbours(spark, blocks):
    folder = "/root/testdata/sf0.01"
    exact = {(r.q_id, r.kb_id) for r in REGISTRY["dense_neighbours"].run(spark, folder).collect() if r.q_id % 20 == 0}
    if blocks:
        vectors = lambda n: spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias(n), R.normalise(F.col("embedding")).alias("v"))
        found = cells.search_cells_approximately(vectors("q_id").filter("q_id % 20 = 0"), vectors("kb_id"), exclude_self=True, **blocks).collect()
    else:
        found = REGISTRY["approximate_neighbours"].run(spark, folder).collect()
    assert all(r.q_id != r.kb_id and r["rank"] <= 3 for r in found) and len({(r.q_id, r.kb_id) for r in found}) == len(found)
    recall = len(exact & {(r.q_id, r.kb_id) for r in found}) / len(exact)
    print("recall", recall)
    assert len(exact) == 75 and recall >= 0.9


def test_odd_vectors(spark):
    rows = list(enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 0.0], [0.0, 1.0]]))
    df, kb = (spark.createDataFrame(rows, f"{name} long, v array<double>") for name in ("q_id", "kb_id"))
    got = {r.q_id: r.kb_id for r in cells.search_cells_approximately(df, kb, k=1, exclude_self=True).collect()}
    assert got[0] == 1 and got[1] == 0
    assert cells.search_cells_approximately(df, kb.limit(0)).count() == 0 and cells.search_cells_approximately(df.limit(0), kb).count() == 0

"""Hot keys: the split forms give the same results as the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cells, encode, portfolio, retrieval, review, skew


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 6), i // 3, i, rng.choice(["approved", "rejected", "escalated"]), rng.random())
            for i in range(3000)]
    return spark.createDataFrame(rows, "tenant bigint, sec bigint, ident bigint, status string, bias double").withColumn(
        "ts", F.timestamp_seconds("sec")
    ).cache()


def test_salted_join_equals_plain_join(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(
        spark.createDataFrame([(7, 70)], "k bigint, v bigint"))
    for how in ("left", "inner"):
        plain = left.join(right, "k", how).select("id", "k", "v")
        salted = skew.join_to_unique(left, right, "k", ["id"], how, broadcast_rows=10, hot_rows=100).select("id", "k", "v")
        assert plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()


def test_time_buckets_bound_the_hot_key(history):
    cut, any_cut = skew.with_time_bucket(history, ["tenant"], "ts", rows=200)
    sizes = {(r.tenant, r._bucket): r["count"] for r in cut.groupBy("tenant", "_bucket").count().collect()}
    assert any_cut and sum(sizes.values()) == 3000
    assert max(sizes.values()) < 260
    assert len([k for k in sizes if k[0] == 0]) >= 8
    order = cut.filter("tenant = 0").groupBy("_bucket").agg(F.min("sec").alias("a"), F.max("sec").alias("b")).orderBy("_bucket").collect()
    assert all(x.b <= y.a for x, y in zip(order, order[1:]))


@pytest.fixture(scope="module")
def one_instant(history):
    """A third of all rows share one time stamp, and the tenant of some is null."""
    return history.withColumn("ts", F.when(F.col("ident") % 3 == 0, F.timestamp_seconds(F.lit(500))).otherwise(F.col("ts"))).withColumn(
        "tenant", F.when(F.col("tenant") != 3, F.col("tenant"))
    ).cache()


def test_rows_of_one_instant_are_parted(one_instant):
    cut, any_cut = skew.with_time_bucket(one_instant, ["tenant"], ["ts", "ident"], rows=100)
    rows = [(r.tenant is None, r.tenant, r.ts, r.ident, r._bucket) for r in cut.collect()]
    assert any_cut and len(rows) == 3000
    by_tenant = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2], r[3])):
        by_tenant.setdefault(row[1], []).append(row[4])
    for buckets in by_tenant.values():
        hot = len(buckets) > 100
        assert buckets == [i // 100 + 1 if hot else 0 for i in range(len(buckets))]


def test_pieces_of_one_instant_equal_one_walk(one_instant):
    audits = one_instant.withColumnsRenamed({"ts": "created_at", "ident": "audit_id"})
    drift = [portfolio.fairness_drift(audits, "tenant", rows=n).orderBy("audit_id").collect() for n in (10**6, 50)]
    assert [r.audit_id for r in drift[0]] == [r.audit_id for r in drift[1]]
    assert np.allclose([r.baseline for r in drift[0]], [r.baseline for r in drift[1]])
    folds = [{r.ident: r for r in review.fold_weights(one_instant, "tenant", "ts", "ident", rows=n, fan=4).collect()} for n in (10**6, 50)]
    assert folds[0] == folds[1]


def test_preceding_average_across_pieces(history):
    audits = history.withColumnsRenamed({"ts": "created_at", "ident": "audit_id"})
    whole = portfolio.fairness_drift(audits, "tenant").orderBy("audit_id").collect()
    cut = portfolio.fairness_drift(audits, "tenant", rows=37).orderBy("audit_id").collect()
    assert [r.audit_id for r in whole] == [r.audit_id for r in cut]
    assert np.allclose([r.baseline for r in whole], [r.baseline for r in cut])


def test_weight_fold_in_pieces_equals_one_walk(history):
    want, at = {}, {}
    for r in history.orderBy("tenant", "ts", "ident").collect():
        if r.status == "escalated":
            continue
        at[r.tenant] = review.next_weights(at.get(r.tenant, review.START), r.status == "approved")
        want[r.ident] = at[r.tenant]
    for rows, fan in ((10**6, 256), (150, 256), (40, 3)):
        log = review.fold_weights(history, "tenant", "ts", "ident", rows=rows, fan=fan).collect()
        got = {r.ident: (r.new_truth, r.new_bias, r.new_confidence) for r in log}
        assert got == want
        assert all(abs(sum(w) - 1) < 2e-4 for w in got.values())


def test_value_codes_of_many_values(spark):
    df = spark.range(3000).select(F.sha1(F.col("id").cast("string")).alias("v"))
    got = {r.value: r.code for r in encode.value_codes(df, "v").collect()}
    want = {v: i for i, v in enumerate(sorted(r.v for r in df.collect()))}
    assert got == want


def test_sliding_count_against_brute_force(spark):
    rng = random.Random(2)
    events = sorted((rng.randrange(2), rng.randrange(20_000)) for _ in range(800))
    df = spark.createDataFrame(events, "key int, sec bigint").withColumn("ts", F.timestamp_seconds("sec"))
    got = {(r.key, r.second): r.prior for r in portfolio.sliding_counts(df, "key", "ts", 50).collect()}
    for key, sec in set(events):
        assert got[key, sec] == sum(k == key and sec - 3600 <= s < sec for k, s in events)


def test_dense_blocks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(120, 8))
    m[5] = m[4]  # a tie
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "i bigint, e array<double>")
    q = df.select(F.col("i").alias("q_id"), retrieval.normalise(F.col("e")).alias("v"))
    kb = df.select(F.col("i").alias("kb_id"), retrieval.normalise(F.col("e")).alias("v"))
    hits = cells.search_cells(q, kb, k=3, exclude_self=True, query_rows=50, passage_rows=30).collect()
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    for i in range(120):
        want = sorted(range(120), key=lambda j: (-round(sims[i, j], 9), j))[:3]
        assert [r.kb_id for r in sorted((h for h in hits if h.q_id == i), key=lambda h: h.rank)] == want

"""Hash chains: built in segments, sealed, and checked; feedback appended with its trigger."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.operators import feedback, store

ORDER = ["ts", "seq"]


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("hot" if i % 2 else None if i % 4 else "cold", 7 if i % 3 == 0 else i, i, None if i % 11 == 0 else f"paid \u00e9 {i}") for i in range(400)]
    return spark.createDataFrame(rows, "log string, ts bigint, seq bigint, what string").cache()


@pytest.fixture(scope="module")
def built(entries):
    chain, seals = store.build_chain(entries, "log", ORDER, F.col("what"), rows=60)
    return chain.cache(), seals.cache()


def _by_segment(chain, seals):
    return {(r["log"], r.segment): r for r in store.verify_sealed(chain, seals, "log", ORDER, F.col("what")).collect()}


def test_chain_equals_a_plain_walk(entries, built):
    logs, want, heads = {}, {}, {}
    for r in sorted(entries.collect(), key=lambda r: (r.ts, r.seq)):
        logs.setdefault(r["log"], []).append(r)
    for log, rows in logs.items():
        for i, r in enumerate(rows):
            segment = i // 60 + 1 if len(rows) > 60 else 0
            at = want[rows[i - 1].seq] if i % 60 else ""
            want[r.seq] = hashlib.sha256("|".join([at] if r.what is None else [at, r.what]).encode()).hexdigest()
            heads[log, segment] = f"{want[r.seq]}:{i % 60 + 1}"
    assert {r.seq: r.hash for r in built[0].collect()} == want
    assert {(r["log"], r.segment): r["head"] for r in built[1].collect()} == heads


def test_an_untouched_log_holds(built):
    assert all(r.sealed and r.broken == 0 for r in _by_segment(*built).values())
    whole = store.verify_chain(built[0], ["log", "segment"], ORDER, F.col("what"))
    assert whole.filter("NOT intact").isEmpty()


def test_changes_show(built):
    chain, seals = built
    last = max((r.ts, r.seq) for r in chain.filter("log = 'hot' AND segment = 2").collect())[1]
    edited = _by_segment(chain.withColumn("what", F.when(F.col("seq") == 101, "x").otherwise(F.col("what"))), seals)
    assert sum(r.broken for r in edited.values()) == 1 and all(r.sealed for r in edited.values())
    cut_off = _by_segment(chain.filter(F.col("seq") != last), seals)
    assert [k for k, r in cut_off.items() if not r.sealed] == [("hot", 2)] and not any(r.broken for r in cut_off.values())
    gone = _by_segment(chain.filter("NOT (log <=> 'hot' AND segment = 3)"), seals)
    assert [k for k, r in gone.items() if not r.sealed] == [("hot", 3)] and gone["hot", 3].entries == 0
    resealed = _by_segment(chain, seals.filter("NOT (log <=> 'hot' AND segment = 2)"))
    assert {k for k, r in resealed.items() if not r.sealed} == {("hot", 2), ("hot", 3)}


def test_empty_log(entries):
    chain, seals = store.build_chain(entries.limit(0), "log", ORDER, F.col("what"))
    assert chain.isEmpty() and seals.isEmpty()
    assert store.verify_sealed(chain, seals, "log", ORDER, F.col("what")).isEmpty()


def test_feedback_counts_every_multiple(spark, tmp_path):
    path = str(tmp_path / "feedback")
    rows = spark.range(13).select(F.col("id").alias("audit_id"), F.lit(True).alias("correct"))
    seen = [feedback.append_feedback(path, rows.filter(f).repartition(3)).first() for f in ("audit_id < 4", "audit_id = 4", "audit_id > 4", "false")]
    assert [(r.n_before, r.n, r.n_due, r.retrain) for r in seen] == [(0, 4, 0, False), (4, 5, 1, True), (5, 13, 1, True), (13, 13, 0, False)]

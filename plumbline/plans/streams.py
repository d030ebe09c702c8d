"""Streaming jobs run to completion over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.inputs import AUDITS, REVIEWS, STATUS_OF
from plumbline.plans.portfolio import DRIFT_SQL
from plumbline.plans.registry import job, rounded
from plumbline.plans.reviews import FOLD
from plumbline.session import scratch_path
from plumbline.streaming import jobs as S


def _events(spark, d):
    """The audits stand-in as a stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    ok = F.col("event_type") != "error"
    events = S.read_stream(spark, d, "events").select(
        F.col("event_id").alias("audit_id"), F.col("user_id").alias("tenant"), "ts", "event_type", k.alias("k"),
        F.when(F.col("event_type") == "purchase", "llm").when(F.col("event_type") == "signup", "text").otherwise("dataset").alias("audit_type"),
        F.when(ok, k / 200.0).alias("bias"), F.when(ok, F.least(F.col("value") / 100.0, F.lit(1.0))).alias("truth"),
    )
    return S.scored(events)


def _naive(df, *columns):
    """Times back to the wall-clock type of the input."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@job("stream_kpi_windows", "ST1", f"""WITH {AUDITS},
w AS (SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS window_start, audit_type, count(*) AS audits, round(sum(trust), 4) AS trust_sum, count(trust) AS scored,
  count(*) FILTER (trust < 0.6) AS high_risk FROM audits GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, audit_type, audits, trust_sum, scored, high_risk FROM w""")
def stream_kpi_windows(spark, d):
    """All windows, also those that the watermark has not closed."""
    out = S.run_updates(S.kpi_windows(_events(spark, d)), "kpi-windows", ["window_start", "audit_type"])
    return rounded(_naive(out, "window_start", "window_end"), 4)


@job("stream_rate_windows", "ST2", """WITH s AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTES, ts) AS slot FROM events),
w AS (SELECT event_type, slot - INTERVAL 5 MINUTES * i AS window_start, count(*) AS events FROM s, range(0, 12) r(i) GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, events, events >= 300 AS over_limit FROM w""")
def stream_rate_windows(spark, d):
    out = S.run_updates(S.rate_windows(_events(spark, d), "event_type"), "rate-windows", ["window_start", "event_type"])
    return _naive(out, "window_start", "window_end")


@job("stream_drift", "ST3", DRIFT_SQL)
def stream_drift(spark, d):
    out = S.run_drift(_events(spark, d), "drift")
    return rounded(_naive(out, "ts").withColumnRenamed("ts", "created_at"))


@job("stream_weight_fold", "ST4", FOLD + """
SELECT d.tenant, d.review_id, n.truth, n.bias, n.confidence FROM d JOIN fold n ON n.tenant = d.tenant AND n.step = d.step""")
def stream_weight_fold(spark, d):
    status = F.lit(None).cast("string")
    for event, name in STATUS_OF.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    decisions = _events(spark, d).select("tenant", "ts", F.col("audit_id").alias("review_id"), status.alias("status"))
    return rounded(S.run_available(S.weight_fold(decisions), "weight-fold").drop("ts"), 4)


@job("stream_scoring", "ST5", f"""WITH {AUDITS}
SELECT audit_id, round(trust, 9) AS trust, CASE WHEN trust < 0.5 THEN 'critical' WHEN trust < 0.6 THEN 'elevated' WHEN trust < 0.75 THEN 'moderate' WHEN trust IS NOT NULL THEN 'low' END AS risk,
  coalesce(trust < 0.6, false) AS queued FROM audits""")
def stream_scoring(spark, d):
    """Audits and queue written by the stream, joined again for comparison."""
    audits_path, queue_path = scratch_path(spark, "stream-audits"), scratch_path(spark, "stream-queue")
    S.score_and_route(_events(spark, d), audits_path, queue_path, scratch_path(spark, "stream-progress")).awaitTermination()
    queue = spark.read.parquet(queue_path).select("audit_id", F.lit(True).alias("q"))
    stored = spark.read.parquet(audits_path).join(queue, "audit_id", "left")
    return rounded(stored.select("audit_id", "trust", "risk", F.coalesce("q", F.lit(False)).alias("queued")))


@job("stream_deduplicated", "ST6", f"WITH {AUDITS} SELECT audit_id, tenant, created_at FROM audits")
def stream_deduplicated(spark, d):
    """Every event sent three times, kept once."""
    tripled = _events(spark, d).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3))))
    out = S.run_available(S.deduplicated(tripled), "deduplicated")
    return _naive(out, "ts").select("audit_id", "tenant", F.col("ts").alias("created_at"))


@job("stream_sessions", "ST7", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g),
c AS (SELECT user_id AS tenant, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS events FROM s GROUP BY user_id, n)
SELECT session_start, session_end, tenant, events, session_end > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS is_open FROM c""")
def stream_sessions(spark, d):
    """All sessions, also those still open when the stream ends."""
    slots = S.run_updates(S.session_slots(_events(spark, d), "tenant"), "session-slots", ["slot", "tenant"])
    return _naive(S.join_slots(slots, "tenant"), "session_start", "session_end")


@job("stream_sessions_closed", "ST7", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g),
c AS (SELECT user_id AS tenant, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS events FROM s GROUP BY user_id, n)
SELECT session_start, session_end, tenant, events FROM c WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions_closed(spark, d):
    """Only what the watermark has closed, as a stream in append mode gives it out."""
    out = S.run_available(S.sessions(_events(spark, d), "tenant"), "sessions")
    return _naive(out, "session_start", "session_end")

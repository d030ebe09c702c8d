"""Portfolio jobs: KPIs, trends, drift, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.operators import portfolio as P
from plumbline.plans.inputs import AUDITS, FEEDBACK, audits, feedback
from plumbline.plans.registry import job, rounded
from plumbline.sources.tables import load

TODAY = "2024-01-15"


@job("dashboard_totals", "A17", f"""WITH {AUDITS}, {FEEDBACK}
SELECT count(*) AS total_audits, round(avg(trust), 2) AS avg_trust, round(avg(bias), 4) AS avg_bias, round(avg(truth), 4) AS avg_truth,
       (SELECT count(*) FROM feedback) AS total_feedback FROM audits""")
def dashboard_totals(spark, d):
    entries = feedback(spark, d).agg(F.count(F.lit(1)).alias("total_feedback"))
    return P.totals(audits(spark, d)).select("*", entries.scalar().alias("total_feedback"))


def _kpi_sql(by: str) -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH {AUDITS},
k AS (SELECT {lead}count(*) AS total_audits, count(*) FILTER (CAST(created_at AS DATE) = DATE '{TODAY}') AS today_audits,
  avg(trust) AS avg_trust, avg(bias) AS avg_bias, avg(truth) AS avg_truth, count(trust) AS scored,
  count(*) FILTER (trust < 0.6) AS high_risk, count(*) FILTER (trust >= 0.75) AS compliant,
  count(*) FILTER (audit_type = 'dataset') AS datasets FROM audits {group}),
r AS (SELECT *, coalesce(high_risk / nullif(scored, 0), 0) AS ratio FROM k)
SELECT {lead}total_audits, today_audits, round(avg_trust, 9) AS avg_trust, round(avg_bias, 9) AS avg_bias, round(avg_truth, 9) AS avg_truth,
  scored, high_risk, compliant, datasets, round(ratio, 9) AS high_risk_ratio,
  round(coalesce(compliant / nullif(scored, 0), 0) * 100, 1) AS compliance_pct,
  total_audits * 240 AS minutes_saved, round(total_audits * 240 / 60, 1) AS hours_saved,
  CASE WHEN (coalesce(avg_trust, 0) <> 0 AND avg_trust < 0.5) OR ratio >= 0.5 THEN 'critical'
       WHEN (coalesce(avg_trust, 0) <> 0 AND avg_trust < 0.6) OR ratio >= 0.25 THEN 'elevated'
       WHEN (coalesce(avg_trust, 0) <> 0 AND avg_trust < 0.75) OR ratio > 0 THEN 'moderate' ELSE 'low' END AS risk_level
FROM r"""


@job("executive_kpis", "A18 A19 P18", _kpi_sql(""))
def executive_kpis(spark, d):
    return rounded(P.executive_kpis(audits(spark, d), F.lit(TODAY).cast("date")))


@job("executive_kpis_by_tenant", "A18 A19 P18", _kpi_sql("tenant"))
def executive_kpis_by_tenant(spark, d):
    return rounded(P.executive_kpis(audits(spark, d), F.lit(TODAY).cast("date"), by=["tenant"]))


@job("mean_report_duration", "A20", f"""WITH {AUDITS},
n AS (SELECT TRY_CAST(report_json->>'$.k' AS DOUBLE) AS s FROM audits WHERE report_json IS NOT NULL ORDER BY created_at DESC, audit_id DESC LIMIT 30)
SELECT round(avg(s), 3) AS mean_seconds, count(s) AS n_reports FROM n""")
def mean_report_duration(spark, d):
    return P.mean_duration(audits(spark, d), "report_json", "$.k")


@job("trust_trend", "W2", f"""WITH {AUDITS}
SELECT audit_id, created_at, round(trust, 9) AS trust, round(bias, 9) AS bias FROM audits ORDER BY created_at DESC, audit_id DESC LIMIT 20""")
def trust_trend(spark, d):
    return rounded(P.trend(audits(spark, d)))


DRIFT_SQL = f"""WITH {AUDITS},
b AS (SELECT tenant, created_at, audit_id, bias,
             coalesce(avg(bias) OVER (PARTITION BY tenant ORDER BY created_at, audit_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), bias) AS baseline
      FROM audits WHERE bias IS NOT NULL),
x AS (SELECT *, bias - baseline AS delta FROM b)
SELECT tenant, created_at, audit_id, round(bias, 9) AS bias, round(baseline, 9) AS baseline, round(delta, 9) AS delta,
       CASE WHEN abs(round(delta, 4)) > 0.1 THEN 'critical' WHEN abs(round(delta, 4)) > 0.05 THEN 'warning' ELSE 'stable' END AS status
FROM x"""


@job("fairness_drift", "W1", DRIFT_SQL)
def fairness_drift(spark, d):
    return rounded(P.fairness_drift(audits(spark, d), "tenant"))


@job("fairness_drift_in_pieces", "W1", DRIFT_SQL)
def fairness_drift_in_pieces(spark, d):
    """The same result with every tenant's history cut into short pieces."""
    return rounded(P.fairness_drift(audits(spark, d), "tenant", rows=40))


@job("newest_drift", "W1 W3", DRIFT_SQL + " QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY created_at DESC, audit_id DESC) = 1")
def newest_drift(spark, d):
    from plumbline.operators.store import latest

    return rounded(latest(P.fairness_drift(audits(spark, d), "tenant"), ["tenant"], ["created_at", "audit_id"]))


@job("latest_or_average", "W8", f"""WITH {AUDITS},
s AS (SELECT tenant, event_type, arg_max(audit_id, (created_at, audit_id)) FILTER (trust IS NOT NULL) AS audit_id,
  arg_max(trust, (created_at, audit_id)) FILTER (trust IS NOT NULL) AS t, arg_max(bias, (created_at, audit_id)) FILTER (trust IS NOT NULL) AS b,
  arg_max(truth, (created_at, audit_id)) FILTER (trust IS NOT NULL) AS f, avg(trust) AS mt, avg(bias) AS mb, avg(truth) AS mf
  FROM audits GROUP BY ALL)
SELECT tenant, event_type, audit_id, round(coalesce(t, mt), 9) AS trust, round(coalesce(b, mb), 9) AS bias, round(coalesce(f, mf), 9) AS truth FROM s""")
def latest_or_average(spark, d):
    return rounded(P.latest_or_average(audits(spark, d), ["tenant", "event_type"]))


@job("hourly_rate_limits", "W9", """WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS events FROM events GROUP BY ALL),
w AS (SELECT *, coalesce(CAST(sum(events) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS prior FROM s)
SELECT user_id, second, events, prior, prior >= 1 AS over_limit FROM w""")
def hourly_rate_limits(spark, d):
    """A limit of one call per hour: the test events are sparse."""
    return P.sliding_counts(load(spark, d, "events"), "user_id", "ts", limit=1)


@job("hourly_rate_limits_by_type", "W9", f"""WITH s AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS events FROM events GROUP BY ALL),
w AS (SELECT *, coalesce(CAST(sum(events) OVER (PARTITION BY event_type ORDER BY second RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS prior FROM s)
SELECT event_type, second, events, prior, prior >= {K.UPLOADS_PER_HOUR} AS over_limit FROM w""")
def hourly_rate_limits_by_type(spark, d):
    """Five keys hold all events: each is cut by the hour, not left to one task."""
    return P.sliding_counts(load(spark, d, "events"), "event_type", "ts", limit=K.UPLOADS_PER_HOUR)

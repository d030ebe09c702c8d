"""Review-queue and feedback jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import feedback as FB
from plumbline.operators import review as RV
from plumbline.plans.inputs import AUDITS, FEEDBACK, REVIEWS, audits, feedback, reviews
from plumbline.plans.registry import job, rounded
from plumbline.session import scratch_path
from plumbline.sources.tables import load

SEVERITY = """CASE WHEN t < 0.5 OR b >= 0.25 OR f < 0.5 THEN 'critical' WHEN t < 0.6 OR b >= 0.15 OR f < 0.7 THEN 'high'
     WHEN t < 0.75 OR b >= 0.1 OR f < 0.8 THEN 'medium' ELSE 'low' END"""

TRIAGE = f"""queue AS (SELECT r.*, a.trust, a.bias, a.truth, coalesce(a.trust, 0) AS t, coalesce(a.bias, 0) AS b, coalesce(a.truth, 0) AS f
  FROM reviews r LEFT JOIN audits a ON a.audit_id = r.audit_id),
triaged AS (SELECT *, CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS sev,
  round(CASE severity WHEN 'critical' THEN 300 WHEN 'high' THEN 200 WHEN 'medium' THEN 100 ELSE 0 END + ((1 - t) * 40 + b * 40 + (1 - f) * 20), 2) AS priority
  FROM (SELECT *, {SEVERITY} AS severity FROM queue))"""


def _queue(spark, d):
    return RV.triage(RV.enrich(reviews(spark, d), audits(spark, d), ["trust", "bias", "truth"]))


@job("review_queue", "J1", f"""WITH {AUDITS}, {REVIEWS}
SELECT review_id, r.audit_id, status, notes, r.created_at, round(trust, 9) AS trust, round(bias, 9) AS bias, round(truth, 9) AS truth
FROM reviews r LEFT JOIN audits a ON a.audit_id = r.audit_id""")
def review_queue(spark, d):
    rows = RV.enrich(reviews(spark, d), audits(spark, d), ["trust", "bias", "truth"])
    return rounded(rows.select("review_id", "audit_id", "status", "notes", "created_at", "trust", "bias", "truth"))


@job("review_page", "T4 W6 U2", f"""WITH {AUDITS}, {REVIEWS}, {TRIAGE},
page AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, review_id DESC) AS pos FROM triaged QUALIFY pos <= 50)
SELECT review_id, status, severity, priority, CAST(row_number() OVER (ORDER BY status = 'pending' DESC, CASE WHEN status = 'pending' THEN priority END DESC NULLS LAST, pos) AS INT) AS place
FROM page""")
def review_page(spark, d):
    """The newest fifty reviews: pending first by priority, the rest as they stood."""
    from pyspark.sql import Window

    page = reviews(spark, d).orderBy(F.col("created_at").desc(), F.col("review_id").desc()).limit(50)
    queue = RV.triage(RV.enrich(page, audits(spark, d), ["trust", "bias", "truth"]))
    numbered = queue.withColumn("pos", F.row_number().over(Window.orderBy(F.col("created_at").desc(), F.col("review_id").desc())))
    return numbered.withColumn("place", F.row_number().over(Window.orderBy(*RV.queue_order("pos")))).select(
        "review_id", "status", "severity", "priority", "place"
    )


@job("triaged_queue", "C18 C19 C20 W6", f"""WITH {AUDITS}, {REVIEWS}, {TRIAGE}
SELECT review_id, audit_id, status, severity, priority,
  CASE severity WHEN 'critical' THEN '4 hours' WHEN 'high' THEN '24 hours' WHEN 'medium' THEN 'this week' ELSE 'routine' END AS urgency,
  CASE WHEN severity = 'critical' AND b >= 0.15 THEN 'high: legal exposure' WHEN severity = 'critical' THEN 'high: false or unsafe output'
       WHEN severity = 'high' THEN 'elevated' WHEN severity = 'medium' THEN 'moderate' ELSE 'low' END AS impact,
  CASE WHEN b >= 0.15 AND b >= 1 - f THEN 'fairness lead' WHEN f < 0.7 THEN 'domain expert' ELSE 'product owner' END
    || CASE WHEN severity = 'critical' THEN ' + compliance sign-off' ELSE '' END AS reviewer,
  CASE WHEN severity = 'critical' THEN 'reject or escalate' WHEN severity = 'high' AND b >= 0.15 THEN 'escalate for mitigation'
       WHEN severity = 'high' THEN 'reject until grounded' WHEN severity = 'medium' THEN 'approve with monitoring' ELSE 'approve' END AS action
FROM triaged""")
def triaged_queue(spark, d):
    queue = RV.prioritised(_queue(spark, d), "review_id")
    return queue.select("review_id", "audit_id", "status", "severity", "priority", "urgency", "impact", "reviewer", "action")


@job("queue_summary", "A22 A23", f"""WITH {AUDITS}, {REVIEWS}, {TRIAGE}
SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
  count(*) FILTER (status = 'pending') AS pending_total, count(*) FILTER (status <> 'pending') AS reviewed_total,
  round(avg(trust), 9) AS mean_trust,
  (SELECT audit_id FROM triaged WHERE status = 'pending' ORDER BY priority DESC, review_id LIMIT 1) AS top_audit_id
FROM triaged""")
def queue_summary(spark, d):
    return rounded(RV.queue_summary(_queue(spark, d)))


@job("risk_labels", "C21", f"""WITH {AUDITS}
SELECT audit_id, CASE WHEN n = '' THEN 'marginal' ELSE n END AS labels FROM (
  SELECT audit_id, concat_ws('|', CASE WHEN truth < 0.5 THEN 'low truth' END, CASE WHEN bias > 0.6 THEN 'high bias' END, CASE WHEN trust < 0.5 THEN 'low trust' END) AS n FROM audits)""")
def risk_labels(spark, d):
    labels = RV.risk_labels(F.col("trust"), F.col("bias"), F.col("truth"))
    return audits(spark, d).select("audit_id", F.array_join(labels, "|").alias("labels"))


@job("review_status_counts", "A21", f"""WITH {AUDITS}, {REVIEWS}
SELECT tenant, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved,
  count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'escalated') AS escalated FROM reviews GROUP BY tenant""")
def review_status_counts(spark, d):
    return RV.status_counts(reviews(spark, d), by=["tenant"])


@job("audits_with_latest_review", "J2 W3", f"""WITH {AUDITS}, {REVIEWS},
l AS (SELECT audit_id, max(review_id) AS review_id, arg_max(status, review_id) AS review_status FROM reviews GROUP BY audit_id)
SELECT a.audit_id, review_id, review_status FROM audits a LEFT JOIN l USING (audit_id)""")
def audits_with_latest_review(spark, d):
    return RV.with_latest_review(audits(spark, d), reviews(spark, d)).select("audit_id", "review_id", "review_status")


@job("checked_decisions", "J7 C24", f"""WITH {AUDITS}, {REVIEWS}
SELECT review_id, audit_id, status, CASE WHEN audit_id NOT IN (SELECT audit_id FROM audits) THEN 'unknown audit'
  WHEN status = 'rejected' AND notes = '' THEN 'rejection needs notes' ELSE 'ok' END AS outcome
FROM reviews WHERE status <> 'pending'""")
def checked_decisions(spark, d):
    """Decisions on known audits, with notes where they are required; the others as rejects."""
    made = reviews(spark, d).filter("status <> 'pending'")
    good, bad = RV.decisions_to_rejects(made, audits(spark, d))
    cols = ["review_id", "audit_id", "status"]
    return good.select(*cols, F.lit("ok").alias("outcome")).unionByName(bad.select(*cols, F.col("reason").alias("outcome")))


@job("current_review_status", "C24 W3", f"""WITH {AUDITS}, {REVIEWS}
SELECT audit_id, status, notes, review_id FROM reviews WHERE status <> 'pending'
QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY created_at DESC, review_id DESC) = 1""")
def current_review_status(spark, d):
    made = reviews(spark, d).filter("status <> 'pending'")
    return RV.current_status(made, ["created_at", "review_id"]).select("audit_id", "status", "notes", "review_id")


@job("routed_to_review", "C9", f"""WITH {AUDITS}
SELECT audit_id, round(trust, 9) AS trust, left(report_json, 200) AS input_preview, 'pending' AS status FROM audits WHERE trust < 0.6""")
def routed_to_review(spark, d):
    return rounded(RV.routed(audits(spark, d).withColumnRenamed("report_json", "input")))


# The fold is ordered and rounds at each step, so the SQL walks one step at a time.
FOLD = f"""WITH RECURSIVE {AUDITS}, {REVIEWS},
d AS (SELECT tenant, review_id, created_at, status = 'approved' AS approved,
             row_number() OVER (PARTITION BY tenant ORDER BY created_at, review_id) AS step
      FROM reviews WHERE status IN ('approved', 'rejected')),
fold(tenant, step, truth, bias, confidence) AS (
  SELECT DISTINCT tenant, CAST(0 AS BIGINT), CAST(0.4 AS DOUBLE), CAST(0.4 AS DOUBLE), CAST(0.2 AS DOUBLE) FROM d
  UNION ALL
  SELECT tenant, step, round(nt / (nt + nb + confidence), 4), round(nb / (nt + nb + confidence), 4), round(confidence / (nt + nb + confidence), 4)
  FROM (SELECT d.tenant, d.step, f.confidence,
               greatest(CAST(0 AS DOUBLE), f.truth + CASE WHEN approved THEN CAST(0.05 AS DOUBLE) ELSE CAST(-0.05 AS DOUBLE) END) AS nt,
               greatest(CAST(0 AS DOUBLE), f.bias - CASE WHEN approved THEN CAST(0.05 AS DOUBLE) ELSE CAST(-0.05 AS DOUBLE) END) AS nb
        FROM fold f JOIN d ON d.tenant = f.tenant AND d.step = f.step + 1))"""

FOLD_LOG = FOLD + """
SELECT d.tenant, d.review_id, d.approved, o.truth AS old_truth, o.bias AS old_bias, o.confidence AS old_confidence,
       n.truth AS new_truth, n.bias AS new_bias, n.confidence AS new_confidence
FROM d JOIN fold o ON o.tenant = d.tenant AND o.step = d.step - 1 JOIN fold n ON n.tenant = d.tenant AND n.step = d.step"""


def _log(spark, d, **bounds):
    log = RV.fold_weights(reviews(spark, d), "tenant", "created_at", "review_id", **bounds)
    return rounded(log.drop("ts").withColumnRenamed("ident", "review_id"), 4)


@job("weight_fold", "W7 C24", FOLD_LOG)
def weight_fold(spark, d):
    return _log(spark, d)


@job("weight_fold_in_pieces", "W7", FOLD_LOG)
def weight_fold_in_pieces(spark, d):
    """The same with every tenant's history cut into short pieces."""
    return _log(spark, d, rows=25)


@job("final_weights", "W7", FOLD + """
SELECT tenant, max(step) AS decisions, arg_max(truth, step) AS truth, arg_max(bias, step) AS bias, arg_max(confidence, step) AS confidence
FROM fold GROUP BY tenant""")
def final_weights(spark, d):
    return rounded(RV.final_weights(RV.fold_weights(reviews(spark, d), "tenant", "created_at", "review_id")), 4)


# --- feedback --------------------------------------------------------------------------


@job("feedback_history", "T5", f"""WITH {AUDITS}, {FEEDBACK}
SELECT feedback_id, audit_id, correct, bias_flag, ts FROM feedback ORDER BY ts DESC, feedback_id DESC LIMIT 50""")
def feedback_history(spark, d):
    return feedback(spark, d).orderBy(F.col("ts").desc(), F.col("feedback_id").desc()).limit(50)


@job("feedback_counts", "C25 A17", f"""WITH {AUDITS}, {FEEDBACK}, c AS (SELECT audit_id, count(*) AS n FROM feedback GROUP BY audit_id)
SELECT a.audit_id, coalesce(n, 0) AS n_feedback FROM audits a LEFT JOIN c USING (audit_id)""")
def feedback_counts(spark, d):
    return FB.with_feedback(audits(spark, d), feedback(spark, d)).select("audit_id", "n_feedback")


@job("proposed_weights", "A24", f"""WITH {AUDITS}, {FEEDBACK},
r AS (SELECT count(*) AS n, avg(CAST(bias_flag AS INT)) AS bias_ratio, avg(CAST(NOT correct AS INT)) AS incorrect_ratio FROM feedback),
w AS (SELECT *, CAST(CASE WHEN incorrect_ratio > 0.3 THEN 0.45 ELSE 0.4 END AS DOUBLE) AS t, CAST(CASE WHEN bias_ratio > 0.3 THEN 0.45 ELSE 0.4 END AS DOUBLE) AS b, CAST(0.2 AS DOUBLE) AS c FROM r)
SELECT n, round(bias_ratio, 9) AS bias_ratio, round(incorrect_ratio, 9) AS incorrect_ratio, round(t / (t + b + c), 4) AS truth,
  round(b / (t + b + c), 4) AS bias, round(c / (t + b + c), 4) AS confidence FROM w""")
def proposed_weights(spark, d):
    return rounded(FB.propose_weights(feedback(spark, d)))


@job("retrain_trigger", "A25", f"""WITH {AUDITS}, {FEEDBACK} SELECT count(*) AS n, count(*) > 0 AND count(*) % 5 = 0 AS retrain FROM feedback""")
def retrain_trigger(spark, d):
    return FB.retrain_due(feedback(spark, d))


@job("feedback_appended", "C25 A25", f"""WITH {AUDITS}, {FEEDBACK}, c AS (SELECT count_if(NOT bias_flag) AS a, count(*) AS b FROM feedback)
SELECT 1 AS step, CAST(0 AS BIGINT) AS n_before, a AS n, a // 5 AS n_due, a // 5 > 0 AS retrain FROM c
UNION ALL SELECT 2, a, b, b // 5 - a // 5, b // 5 - a // 5 > 0 FROM c""")
def feedback_appended(spark, d):
    """Two batches appended to one store, each with the trainings it sets off."""
    path = scratch_path(spark, "feedback")
    rows = feedback(spark, d)
    first = FB.append_feedback(path, rows.filter("NOT bias_flag")).withColumn("step", F.lit(1))
    second = FB.append_feedback(path, rows.filter("bias_flag")).withColumn("step", F.lit(2))
    return first.unionByName(second)


@job("checked_weights", "C4", """WITH p AS (SELECT event_id, CAST(props->>'$.k' AS INT) / 100.0::DOUBLE AS truth, least(value / 100.0::DOUBLE, 1.2::DOUBLE) AS bias, 0.2::DOUBLE AS confidence FROM events),
t AS (SELECT *, truth + bias + confidence AS total FROM p),
v AS (SELECT *, truth BETWEEN 0 AND 1 AND bias BETWEEN 0 AND 1 AND confidence BETWEEN 0 AND 1 AND abs(total - 1) <= 0.02 AS valid FROM t)
SELECT event_id, round(total, 9) AS total, valid, CASE WHEN valid THEN round(truth / total, 4) END AS truth_scaled,
  CASE WHEN valid THEN round(bias / total, 4) END AS bias_scaled, CASE WHEN valid THEN round(confidence / total, 4) END AS confidence_scaled FROM v""")
def checked_weights(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    proposals = load(spark, d, "events").select(
        "event_id", (k / 100.0).alias("truth"), F.least(F.col("value") / 100.0, F.lit(1.2)).alias("bias"), F.lit(0.2).alias("confidence")
    )
    return rounded(FB.check_weights(proposals).drop("truth", "bias", "confidence"))


@job("trust_under_presets", "C4 J5", f"""WITH {AUDITS}, p AS (SELECT * FROM (VALUES ('general', 0.40, 0.40, 0.20), ('healthcare', 0.45, 0.35, 0.20), ('finance', 0.38, 0.42, 0.20), ('hiring', 0.35, 0.45, 0.20)) v(preset, wt, wb, wc))
SELECT audit_id, preset, round(CASE WHEN truth IS NOT NULL THEN greatest(0, least(1, wt::DOUBLE * truth + wb::DOUBLE * (1 - bias) + wc::DOUBLE * 0.85)) END, 9) AS trust FROM audits, p""")
def trust_under_presets(spark, d):
    scored = FB.score_under_presets(audits(spark, d).drop("trust").withColumn("confidence", F.lit(0.85)), "truth", "bias", "confidence")
    return rounded(scored.select("audit_id", "preset", "trust"))

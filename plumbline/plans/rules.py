"""Scoring, compliance and recommendation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import scores
from plumbline.operators import correction as CR
from plumbline.operators import recommend as RC
from plumbline.operators import rules as RU
from plumbline.plans.inputs import AUDITS, DECISIONS, audits, decisions
from plumbline.plans.registry import job, rounded
from plumbline.sources.tables import load

# The compliance rules read a missing score as zero; no audit is left out.
SCORED = f"""{AUDITS}, scored AS (SELECT * REPLACE (coalesce(trust, 0::DOUBLE) AS trust, coalesce(bias, 0::DOUBLE) AS bias, coalesce(truth, 0::DOUBLE) AS truth) FROM audits)"""
STATUS = "CASE WHEN trust IS NULL THEN 'unscored' ELSE 'scored' END AS status"
BAND = "CASE WHEN trust < 0.5 THEN 'critical' WHEN trust < 0.6 THEN 'elevated' WHEN trust < 0.75 THEN 'moderate' WHEN trust IS NOT NULL THEN 'low' END"


def _scored(spark, d):
    return audits(spark, d).fillna(0.0, ["trust", "bias", "truth"])


def _status(trust):
    return F.when(trust.isNull(), "unscored").otherwise("scored").alias("status")


@job("trust_components", "C3", f"""WITH {AUDITS}
SELECT audit_id, {STATUS}, round(truth * 0.4, 9) AS truth_part, round((1 - bias) * 0.4, 9) AS bias_part, round(CAST(0.85 * 0.2 AS DOUBLE), 9) AS confidence_part, round(trust, 9) AS trust FROM audits""")
def trust_components(spark, d):
    parts = scores.trust_parts(F.col("truth"), F.col("bias"), F.lit(K.DEFAULT_CONFIDENCE))
    rows = audits(spark, d).select("audit_id", _status(F.col("trust")), "trust", parts.alias("p"))
    trust = F.when(F.col("trust").isNotNull(), F.col("p.trust"))
    return rounded(
        rows.select("audit_id", "status", F.col("p.truth").alias("truth_part"), F.col("p.bias").alias("bias_part"),
                    F.col("p.confidence").alias("confidence_part"), trust.alias("trust"))
    )


@job("weighted_sums", "C2", f"""WITH {AUDITS} SELECT audit_id, {STATUS}, round(truth * 0.5 + bias * 0.3 + k * 0.2, 9) AS y FROM audits""")
def weighted_sums(spark, d):
    values = F.array("truth", "bias", F.col("k").cast("double"))
    y = scores.weighted_sum(values, F.lit([0.5, 0.3, 0.2]))
    return rounded(audits(spark, d).select("audit_id", _status(F.col("trust")), y.alias("y")))


@job("risk_bands", "C7 C9 C13 D7", f"""WITH {AUDITS}
SELECT audit_id, {BAND} AS risk, CASE WHEN trust >= 0.7 THEN 'approve' WHEN trust IS NOT NULL THEN 'correct' END AS decision, trust < 0.6 AS requires_review,
  CASE WHEN trust < 0.5 THEN 'unsafe' WHEN trust < 0.7 THEN 'caution' WHEN trust < 0.9 THEN 'acceptable' WHEN trust IS NOT NULL THEN 'trusted' END AS level
FROM audits""")
def risk_bands(spark, d):
    t = F.col("trust")
    return audits(spark, d).select(
        "audit_id", scores.risk_band(t).alias("risk"), scores.decision(t).alias("decision"),
        scores.needs_review(t).alias("requires_review"), scores.trust_level(t).alias("level"),
    )


@job("mode_defaults", "C5 C6", f"""WITH {AUDITS}
SELECT audit_id, audit_type, CAST(CASE WHEN audit_type = 'text' THEN 0.5 ELSE coalesce(bias, 0.5) END AS DOUBLE) AS bias,
  CAST(CASE WHEN audit_type = 'text' THEN 0.5 WHEN audit_type = 'llm' THEN 0.85 END AS DOUBLE) AS cluster, CAST(CASE WHEN audit_type = 'text' THEN 0.5 WHEN audit_type = 'llm' THEN 0.9 END AS DOUBLE) AS distribution
FROM audits""")
def mode_defaults(spark, d):
    """Neutral signals of text audits, and the placeholders of a fast audit (here: 'llm')."""
    text, fast = F.col("audit_type") == "text", F.col("audit_type") == "llm"
    return audits(spark, d).select(
        "audit_id", "audit_type",
        F.when(text, K.TEXT_NEUTRAL).otherwise(F.coalesce("bias", F.lit(K.TEXT_NEUTRAL))).alias("bias"),
        F.when(text, K.TEXT_NEUTRAL).when(fast, K.FAST_CLUSTER).alias("cluster"),
        F.when(text, K.TEXT_NEUTRAL).when(fast, K.FAST_DISTRIBUTION).alias("distribution"),
    )


@job("score_deltas", "C12", f"""WITH {DECISIONS},
r AS (SELECT dataset, abs(coalesce(avg(label) FILTER (segment = 'AUTOMOBILE'), 0) - coalesce(avg(label) FILTER (segment = 'BUILDING'), 0)) AS gap FROM decisions GROUP BY dataset),
s AS (SELECT dataset, 0.2 + 0.4 * (1 - gap) + 0.17 AS before, 0.2 + 0.4 * (1 - gap * 0.6) + 0.17 AS after FROM r)
SELECT dataset, round(before, 4) AS trust_before, round(after, 4) AS trust_after, round(after - before, 4) AS trust_delta FROM s""")
def score_deltas(spark, d):
    """Trust of each dataset before and after its bias is eased, and the difference."""
    from plumbline.operators import fairness as FA

    gaps = FA.parity_gap(decisions(spark, d), "label", "segment", "AUTOMOBILE", "BUILDING", by=["dataset"])
    confidence, truth = F.lit(K.DEFAULT_CONFIDENCE), F.lit(K.TEXT_NEUTRAL)
    out = gaps.select(
        "dataset", scores.trust_score(truth, F.col("parity_gap"), confidence).alias("trust_before"),
        scores.trust_score(truth, F.col("parity_gap") * 0.6, confidence).alias("trust_after"),
    )
    return rounded(out.withColumn("trust_delta", F.col("trust_after") - F.col("trust_before")), 4)


@job("extracted_scores", "C16", f"""WITH {AUDITS}
SELECT audit_id, round(coalesce(trust, CAST(report_json->>'$.k' AS DOUBLE) * 0), 9) AS trust, round(coalesce(bias, 0), 9) AS bias,
  CAST(0 AS DOUBLE) AS truth, CAST(0 AS DOUBLE) AS cluster, CAST(k AS DOUBLE) AS distribution FROM audits""")
def extracted_scores(spark, d):
    """Flat columns first, then nested JSON, then zero."""
    rows = audits(spark, d).select(
        "audit_id", F.col("trust").alias("trust_score"), F.col("bias").alias("bias_score"),
        F.to_json(
            F.struct(
                F.struct(F.lit("not a number").alias("truth_score")).alias("truth"),
                F.struct(F.col("k").alias("distribution_stability")).alias("distribution"),
            )
        ).alias("report_json"),
    )
    return rounded(RU.extract_scores(rows).select("audit_id", "trust", "bias", "truth", "cluster", "distribution"))


@job("compliance_rows", "C14 J5", f"""WITH {SCORED},
f AS (SELECT * FROM (VALUES {', '.join(str(tuple(f)) for f in K.FRAMEWORKS)}) v(framework, name, reference, domain)),
m AS (
  SELECT audit_id, 'eeoc' AS framework, CASE WHEN bias >= 0.2 THEN 'violation' WHEN bias >= 0.1 THEN 'attention' ELSE 'pass' END AS status FROM scored
  UNION ALL SELECT audit_id, 'ecoa', 'attention' FROM scored WHERE bias >= 0.2
  UNION ALL SELECT audit_id, 'who', CASE WHEN truth < 0.5 THEN 'violation' WHEN truth < 0.7 THEN 'attention' ELSE 'pass' END FROM scored
  UNION ALL SELECT audit_id, unnest(['eu_ai_act', 'nist_ai_rmf']), CASE WHEN bias >= 0.1 OR truth < 0.75 THEN 'attention' ELSE 'pass' END FROM scored
  UNION ALL SELECT audit_id, 'gdpr', 'attention' FROM scored WHERE k < 50)
SELECT audit_id, framework, status, name, reference, domain FROM m JOIN f USING (framework)""")
def compliance_rows(spark, d):
    return RU.compliance_rows(_scored(spark, d), "audit_id", "bias", "truth", F.col("k") < 50)


@job("advice", "C15", f"""WITH {SCORED},
a AS (SELECT audit_id, concat_ws('|', CASE WHEN bias >= 0.2 THEN 'halt_decisions|mitigate_and_reaudit' WHEN bias >= 0.1 THEN 'justify_and_schedule' END,
  CASE WHEN truth < 0.7 THEN 'ground_answers' WHEN truth < 0.85 THEN 'extend_knowledge_base' END, CASE WHEN k <> 0 AND k / 100 < 0.7 THEN 'inspect_training_data' END) AS s FROM scored)
SELECT audit_id, CASE WHEN s = '' THEN 'keep_controls' ELSE s END || '|file_report' AS codes FROM a""")
def advice(spark, d):
    codes = RU.recommendations(F.col("bias"), F.col("truth"), F.col("k") / 100)
    return _scored(spark, d).select("audit_id", F.array_join(codes, "|").alias("codes"))


@job("next_actions", "C15", f"""WITH {SCORED}
SELECT audit_id, 'human_review' AS action, 'compliance lead' AS owner, 'immediate' AS urgency FROM scored WHERE trust < 0.6
UNION ALL SELECT audit_id, 'mitigate_bias', 'ml engineer', CASE WHEN bias >= 0.2 THEN 'high' ELSE 'medium' END FROM scored WHERE bias >= 0.1
UNION ALL SELECT audit_id, 'improve_grounding', 'content owner', 'medium' FROM scored WHERE truth < 0.75
UNION ALL SELECT audit_id, 'archive_report', 'compliance operations', 'routine' FROM scored""")
def next_actions(spark, d):
    steps = RU.next_actions(F.col("trust"), F.col("bias"), F.col("truth"))
    return _scored(spark, d).select("audit_id", F.inline(steps))


FLAG_TEXT = """docs AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'Loan terms. ' WHEN source = 'src7' THEN 'The DOSAGE. ' ELSE '' END || text AS text,
  least(n_chars / CAST(10000 AS DOUBLE), CAST(1 AS DOUBLE)) AS bias, least(n_chars / CAST(5000 AS DOUBLE), CAST(1 AS DOUBLE)) AS truth FROM documents)"""


@job("regulatory_flags", "C10", f"""WITH {FLAG_TEXT}
SELECT doc_id, concat_ws('|', CASE WHEN bias > 0.15 AND regexp_matches(lower(text), 'zip code|zip_code|mortgage|loan') THEN 'lending_proxy' END,
  CASE WHEN truth < 0.8 AND regexp_matches(lower(text), 'drug|dosage|medicine|patient') THEN 'medical_claim' END,
  CASE WHEN truth < 0.7 OR bias < 0.6 THEN 'data_quality' END) AS flags FROM docs""")
def regulatory_flags(spark, d):
    lead = F.when(F.col("source").isin("src1", "src2"), "Loan terms. ").when(F.col("source") == "src7", "The DOSAGE. ").otherwise("")
    docs = load(spark, d, "documents").select(
        "doc_id", F.concat(lead, "text").alias("text"),
        F.least(F.col("n_chars") / 10000, F.lit(1.0)).alias("bias"), F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("truth"),
    )
    flags = RU.regulatory_flags(F.col("bias"), F.col("truth"), F.col("text"), F.col("bias"), F.col("truth"))
    return docs.select("doc_id", F.array_join(flags, "|").alias("flags"))


@job("compliance_summary", "C15 C17", f"""WITH {SCORED},
p AS (SELECT *, {BAND} AS risk, CAST(round_even(trust * 100, 0) AS INT) AS tp, CAST(round_even(bias * 100, 0) AS INT) AS bp, CAST(round_even(truth * 100, 0) AS INT) AS fp FROM scored)
SELECT audit_id, risk, 'Trust ' || tp || '/100, ' || risk || ' risk' AS headline,
  'The ' || audit_type || ' audit reached ' || tp || ' of 100 (' || risk || ' risk) with a group disparity of ' || bp || '% and a grounding of ' || fp || '%. '
    || CASE WHEN risk IN ('critical', 'elevated') THEN 'Remediate before production use.' WHEN risk = 'moderate' THEN 'Usable with monitoring.' ELSE 'Suitable for production use.' END AS summary,
  CASE WHEN bias < 0.1 AND truth >= 0.75 THEN 'No material risk found.' ELSE 'Main risks: ' || concat_ws('; ', CASE WHEN bias >= 0.1 THEN 'group disparity of ' || bp || '%' END, CASE WHEN truth < 0.75 THEN 'grounding of only ' || fp || '%' END) || '.' END AS business_risk,
  CASE WHEN risk IN ('critical', 'elevated') THEN 'do_not_deploy' WHEN risk = 'moderate' THEN 'deploy_with_monitoring' ELSE 'approve' END AS action,
  4 + CASE WHEN bias >= 0.2 THEN 1 ELSE 0 END AS n_frameworks, trust < 0.6 AS requires_review
FROM p""")
def compliance_summary(spark, d):
    rows = _scored(spark, d).withColumns(
        {"cluster": F.lit(0.5), "distribution": F.lit(0.5), "flags": F.array().cast("array<string>")}
    )
    return RU.compliance_summary(rows).select(
        "audit_id", "risk", "headline", "summary", "business_risk", F.col("value.action").alias("action"),
        F.size("mapping").alias("n_frameworks"), "requires_review",
    )


@job("adjusted_importance", "C1", f"""WITH {DECISIONS},
c AS (SELECT dataset, segment, count(*) AS n FROM decisions GROUP BY ALL),
s AS (SELECT dataset, segment, n / CAST(sum(n) OVER (PARTITION BY dataset) AS DOUBLE) AS share FROM c)
SELECT dataset, segment, share > 0.25 AS flagged, round(CASE WHEN share > 0.25 THEN share * 0.5 ELSE share END, 4) AS adjusted FROM s""")
def adjusted_importance(spark, d):
    """Shares above a quarter are flagged and halved, on a map per dataset."""
    counts = decisions(spark, d).groupBy("dataset", "segment").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    entry = F.collect_list(F.struct("segment", F.col("n").cast("double").alias("n")))
    maps = counts.groupBy("dataset").agg(total.alias("total"), entry.alias("e"))
    shares = F.map_from_entries(F.transform("e", lambda x: F.struct(x["segment"], x["n"] / F.col("total"))))
    fixed = maps.select("dataset", CR.adjust_importance(shares).alias("a"))
    return fixed.select("dataset", F.explode("a.adjusted").alias("segment", "adjusted"), F.col("a.flagged").alias("f")).select(
        "dataset", "segment", F.array_contains("f", F.col("segment")).alias("flagged"), "adjusted"
    )


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _catalogue(spark, d):
    """(dataset, column, n_rows) of all given tables; names come from the schemas."""
    out = None
    for name in TABLES:
        df = load(spark, d, name)
        columns = F.explode(F.lit(df.columns))
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("dataset"), columns.alias("column"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


CATALOGUE_SQL = "catalogue AS (SELECT c.table_name AS dataset, c.column_name AS \"column\", n.n_rows FROM information_schema.columns c JOIN (" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, count(*) AS n_rows FROM {t}" for t in TABLES) + ") n ON n.t = c.table_name)"


def _hits(words: list[str]) -> str:
    return f"count(*) FILTER (regexp_matches(lower(\"column\"), '{'|'.join(words)}'))"


SIGNALS_SQL = "signals AS (SELECT dataset, count(*) AS n_columns, max(n_rows) AS n_rows, " + ", ".join(
    f"{_hits(words)} AS {domain}" for domain, words in K.DOMAIN_KEYWORDS.items()
) + f", {_hits(K.PROTECTED_NAME_HINTS)} AS n_protected FROM catalogue GROUP BY dataset)"


@job("domain_signals", "A28", f"WITH {CATALOGUE_SQL}, {SIGNALS_SQL} SELECT * FROM signals")
def domain_signals(spark, d):
    return RC.domain_signals(_catalogue(spark, d))


@job("protected_columns", "C23", f"""WITH {CATALOGUE_SQL}
SELECT dataset, "column", regexp_matches(lower("column"), '{'|'.join(K.PROTECTED_NAME_HINTS)}') AS protected FROM catalogue""")
def protected_columns(spark, d):
    return RC.protected_columns(_catalogue(spark, d)).select("dataset", "column", "protected")


_DOMAINS = list(K.DOMAIN_KEYWORDS)


@job("recommended_audits", "C22 A28 J5", f"""WITH {CATALOGUE_SQL}, {SIGNALS_SQL},
b AS (SELECT *, greatest({', '.join(_DOMAINS)}) AS best FROM signals),
c AS (SELECT *, CASE WHEN best = 0 THEN 'general' {' '.join(f"WHEN {x} = best THEN '{x}'" for x in _DOMAINS)} END AS domain FROM b)
SELECT dataset, n_columns, n_rows, n_protected, domain, best AS signals,
  CASE WHEN n_rows >= 2000 OR n_columns >= 15 THEN 'thorough' WHEN n_rows <= 200 AND n_columns <= 6 THEN 'fast' ELSE 'standard' END AS depth,
  CASE domain {' '.join(f"WHEN '{x}' THEN '{p[0]}'" for x, p in K.DOMAIN_PROFILES.items())} END AS preset,
  CASE domain {' '.join(f"WHEN '{x}' THEN '{p[1]}'" for x, p in K.DOMAIN_PROFILES.items())} END AS framework,
  CASE WHEN n_protected > 0 THEN 'high' ELSE 'standard' END AS explainability,
  CASE WHEN domain <> 'general' AND n_protected > 0 THEN 'high' WHEN domain <> 'general' OR n_protected > 0 THEN 'medium' ELSE 'standard' END AS review_priority,
  CASE WHEN domain <> 'general' OR n_protected > 0 THEN 'executive' ELSE 'standard' END AS report_detail,
  CASE WHEN domain <> 'general' THEN upper(left(domain, 1)) || substring(domain, 2) || ' Compliance Audit' WHEN n_protected > 0 THEN 'Fairness-Focused Audit' ELSE 'General Trust Audit' END AS profile
FROM c""")
def recommended_audits(spark, d):
    return RC.recommend(_catalogue(spark, d))

"""Regulatory flags, framework mapping and advice derived from the scores of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import scores


def frameworks(spark) -> DataFrame:
    """The six compliance frameworks."""
    return spark.createDataFrame(K.FRAMEWORKS, "framework string, name string, reference string, domain string")


def mentions(text: Column, words: list[str]) -> Column:
    lowered = F.lower(text)
    hit = F.lit(False)
    for w in words:
        hit = hit | lowered.contains(w)
    return F.coalesce(hit, F.lit(False))


def regulatory_flags(
    bias: Column, truth: Column, text: Column, cluster: Column, distribution: Column, uses_zip: Column | None = None
) -> Column:
    """Array of flag codes: lending proxy, medical claims, training-data quality."""
    lending = mentions(text, K.LENDING_WORDS)
    if uses_zip is not None:
        lending = lending | uses_zip
    return F.array_compact(
        F.array(
            F.when((bias > 0.15) & lending, "lending_proxy"),
            F.when((truth < 0.8) & mentions(text, K.MEDICAL_WORDS), "medical_claim"),
            F.when((distribution < 0.7) | (cluster < 0.6), "data_quality"),
        )
    )


def framework_status(bias: Column, truth: Column, flagged: Column) -> Column:
    """Array of (framework, status); frameworks a record does not touch are absent."""

    def row(key: str, status: Column) -> Column:
        return F.when(status.isNotNull(), F.struct(F.lit(key).alias("framework"), status.alias("status")))

    governance = F.when((bias >= 0.10) | (truth < 0.75), "attention").otherwise("pass")
    return F.array_compact(
        F.array(
            row("eeoc", F.when(bias >= 0.20, "violation").when(bias >= 0.10, "attention").otherwise("pass")),
            row("ecoa", F.when(bias >= 0.20, "attention")),
            row("who", F.when(truth < 0.50, "violation").when(truth < 0.70, "attention").otherwise("pass")),
            row("eu_ai_act", governance),
            row("nist_ai_rmf", governance),
            row("gdpr", F.when(flagged, "attention")),
        )
    )


def compliance_rows(df: DataFrame, key: str, bias: str, truth: str, flagged: Column) -> DataFrame:
    """One row per (audit, framework) with the framework's name and reference."""
    found = framework_status(F.col(bias), F.col(truth), flagged)
    long = df.select(key, F.inline(found))
    return long.join(F.broadcast(frameworks(df.sparkSession)), "framework")


def recommendations(bias: Column, truth: Column, distribution: Column) -> Column:
    """Codes of the advice that applies, most urgent first."""
    unstable = (distribution != 0) & (distribution < 0.7)
    specific = F.array_compact(
        F.array(
            F.when(bias >= 0.20, "halt_decisions"),
            F.when(bias >= 0.20, "mitigate_and_reaudit"),
            F.when((bias >= 0.10) & (bias < 0.20), "justify_and_schedule"),
            F.when(truth < 0.70, "ground_answers"),
            F.when((truth >= 0.70) & (truth < 0.85), "extend_knowledge_base"),
            F.when(unstable, "inspect_training_data"),
        )
    )
    return F.concat(
        F.when(F.size(specific) == 0, F.array(F.lit("keep_controls"))).otherwise(specific),
        F.array(F.lit("file_report")),
    )


def next_actions(trust: Column, bias: Column, truth: Column) -> Column:
    """(action, owner, urgency) steps."""

    def step(action: str, owner: str, urgency) -> Column:
        return F.struct(
            F.lit(action).alias("action"),
            F.lit(owner).alias("owner"),
            (urgency if isinstance(urgency, Column) else F.lit(urgency)).alias("urgency"),
        )

    return F.array_compact(
        F.array(
            F.when(trust < K.BANDS["elevated"], step("human_review", "compliance lead", "immediate")),
            F.when(bias >= 0.10, step("mitigate_bias", "ml engineer", F.when(bias >= 0.2, "high").otherwise("medium"))),
            F.when(truth < 0.75, step("improve_grounding", "content owner", "medium")),
            step("archive_report", "compliance operations", "routine"),
        )
    )


def customer_value(trust: Column) -> Column:
    """(impact, compliance, action, reviewer) codes by risk band."""
    band = scores.risk_band(trust)
    risky = band.isin("critical", "elevated")

    def pick(high: str, middle: str, low: str) -> Column:
        return F.when(risky, high).when(band == "moderate", middle).otherwise(low)

    return F.struct(
        pick("high", "moderate", "low").alias("impact"),
        pick("likely_non_compliant", "partly_compliant", "compliant").alias("compliance"),
        pick("do_not_deploy", "deploy_with_monitoring", "approve").alias("action"),
        pick("compliance lead and ml engineer", "product owner with compliance", "product owner").alias("reviewer"),
    )


def headline(trust: Column) -> Column:
    return F.concat(F.lit("Trust "), scores.percent(trust).cast("string"), F.lit("/100, "), scores.risk_band(trust), F.lit(" risk"))


def summary_text(audit_type: Column, trust: Column, bias: Column, truth: Column) -> Column:
    """One paragraph of prose built from the numbers."""
    band = scores.risk_band(trust)
    stance = (
        F.when(band.isin("critical", "elevated"), "Remediate before production use.")
        .when(band == "moderate", "Usable with monitoring.")
        .otherwise("Suitable for production use.")
    )
    return F.format_string(
        "The %s audit reached %d of 100 (%s risk) with a group disparity of %d%% and a grounding of %d%%. %s",
        audit_type, scores.percent(trust), band, scores.percent(bias), scores.percent(truth), stance,
    )


def risk_text(bias: Column, truth: Column) -> Column:
    """The business risks in a sentence, or that there are none."""
    parts = F.array_compact(
        F.array(
            F.when(bias >= 0.10, F.format_string("group disparity of %d%%", scores.percent(bias))),
            F.when(truth < 0.75, F.format_string("grounding of only %d%%", scores.percent(truth))),
        )
    )
    return F.when(F.size(parts) == 0, "No material risk found.").otherwise(
        F.concat(F.lit("Main risks: "), F.array_join(parts, "; "), F.lit("."))
    )


def extract_scores(df: DataFrame, report: str = "report_json") -> DataFrame:
    """Scores from flat columns, else from the report JSON (nested or flat), else zero."""

    def picked(flat: str, *paths: str) -> Column:
        tries = [F.col(flat)] if flat in df.columns else []
        tries += [F.expr(f"try_cast(get_json_object({report}, '{p}') as double)") for p in paths]
        return F.coalesce(*tries, F.lit(0.0))

    return df.withColumns(
        {
            "trust": picked("trust_score", "$.trust_score", "$.trust.trust_score"),
            "bias": picked("bias_score", "$.bias.bias_score", "$.bias_score"),
            "truth": picked("truth_score", "$.truth.truth_score", "$.truth_score"),
            "cluster": picked("cluster_fairness", "$.cluster.cluster_fairness"),
            "distribution": picked("distribution_stability", "$.distribution.distribution_stability"),
        }
    )


def compliance_summary(df: DataFrame) -> DataFrame:
    """One wide row per audit: band, flags-driven mapping, advice, actions, value, prose.

    Expects ``audit_id, audit_type, trust, bias, truth, cluster, distribution, flags``.
    """
    t, b, f = F.col("trust"), F.col("bias"), F.col("truth")
    return df.withColumns(
        {
            "risk": scores.risk_band(t),
            "headline": headline(t),
            "mapping": framework_status(b, f, F.size("flags") > 0),
            "advice": recommendations(b, f, F.col("distribution")),
            "actions": next_actions(t, b, f),
            "value": customer_value(t),
            "summary": summary_text(F.col("audit_type"), t, b, f),
            "business_risk": risk_text(b, f),
            "requires_review": scores.needs_review(t),
        }
    )

"""Aggregates over stored audits: KPIs, trends, drift, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import stats
from plumbline.operators.skew import HOT_ROWS, with_preceding


def totals(audits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Audit count and mean scores."""
    return audits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_audits"),
        F.round(F.avg("trust"), 2).alias("avg_trust"),
        F.round(F.avg("bias"), 4).alias("avg_bias"),
        F.round(F.avg("truth"), 4).alias("avg_truth"),
    )


def risk_level(avg_trust: Column, high_risk_ratio: Column) -> Column:
    """Portfolio level from mean trust and the share of high-risk audits; no mean, no say."""
    known = F.coalesce(avg_trust, F.lit(0.0)) != 0

    def at(limit: float, share: Column) -> Column:
        return (known & (avg_trust < limit)) | share

    return (
        F.when(at(K.BANDS["critical"], high_risk_ratio >= 0.5), "critical")
        .when(at(K.BANDS["elevated"], high_risk_ratio >= 0.25), "elevated")
        .when(at(K.BANDS["moderate"], high_risk_ratio > 0), "moderate")
        .otherwise("low")
    )


def executive_kpis(
    audits: DataFrame, as_of: Column, by: Sequence[str] = (), minutes: int = K.MANUAL_MINUTES
) -> DataFrame:
    """Every executive figure on the audits table from one pass; ``as_of`` is 'today'."""
    trust = F.col("trust")
    out = audits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_audits"),
        stats.count_where(F.to_date("created_at") == as_of).alias("today_audits"),
        F.avg(trust).alias("avg_trust"),
        F.avg("bias").alias("avg_bias"),
        F.avg("truth").alias("avg_truth"),
        F.count(trust).alias("scored"),
        stats.count_where(trust < K.BANDS["elevated"]).alias("high_risk"),
        stats.count_where(trust >= K.BANDS["moderate"]).alias("compliant"),
        stats.count_where(F.col("audit_type") == "dataset").alias("datasets"),
    )
    return (
        out.withColumn("high_risk_ratio", stats.ratio_or_zero(F.col("high_risk"), F.col("scored")))
        .withColumn("compliance_pct", F.round(stats.ratio_or_zero(F.col("compliant"), F.col("scored")) * 100, 1))
        .withColumn("minutes_saved", F.col("total_audits") * minutes)
        .withColumn("hours_saved", F.round(F.col("minutes_saved") / 60, 1))
        .withColumn("risk_level", risk_level(F.col("avg_trust"), F.col("high_risk_ratio")))
    )


def mean_duration(audits: DataFrame, report: str, path: str, newest: int = 30) -> DataFrame:
    """Mean stored duration over the newest reports; null where none carries one."""
    recent = (
        audits.filter(F.col(report).isNotNull())
        .orderBy(F.col("created_at").desc(), F.col("audit_id").desc())
        .limit(newest)
    )
    seconds = F.expr(f"try_cast(get_json_object({report}, '{path}') as double)")
    return recent.agg(F.round(F.avg(seconds), 3).alias("mean_seconds"), F.count(seconds).alias("n_reports"))


def trend(audits: DataFrame, newest: int = 20) -> DataFrame:
    """The newest audits, oldest first, as a chart reads them."""
    recent = audits.orderBy(F.col("created_at").desc(), F.col("audit_id").desc()).limit(newest)
    return recent.select("audit_id", "created_at", "trust", "bias").orderBy("created_at", "audit_id")


def drift_status(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size > K.DRIFT_CRITICAL, "critical").when(size > K.DRIFT_WARNING, "warning").otherwise("stable")


def fairness_drift(
    audits: DataFrame, tenant: str, ts: str = "created_at", ident: str = "audit_id",
    history: int = K.DRIFT_HISTORY, rows: int = HOT_ROWS,
) -> DataFrame:
    """Bias of every audit against the mean of the ``history`` audits before it.

    Audits without a bias score are left out first. The first audit of a tenant is its
    own baseline. The newest row per tenant is the dashboard's figure.
    """
    scored = audits.filter(F.col("bias").isNotNull()).select(tenant, ts, ident, "bias")
    seen = with_preceding(scored, [tenant], [ts, ident], "bias", history, rows, out="baseline")
    return (
        seen.withColumn("baseline", F.coalesce("baseline", "bias"))
        .withColumn("delta", F.col("bias") - F.col("baseline"))
        .withColumn("status", drift_status(F.round("delta", 4)))
    )


def latest_or_average(audits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores of the latest scored audit per key, or the key's means where none is scored."""
    order = F.struct("created_at", "audit_id")
    scored = F.when(F.col("trust").isNotNull(), order)
    return audits.groupBy(*by).agg(
        F.max_by(F.when(F.col("trust").isNotNull(), F.col("audit_id")), scored).alias("audit_id"),
        *[
            F.coalesce(F.max_by(c, scored), F.avg(c)).alias(c)
            for c in ("trust", "bias", "truth")
        ],
    )


def sliding_counts(
    events: DataFrame, key: str, ts: str, limit: int, window: int = K.RATE_WINDOW_SECONDS
) -> DataFrame:
    """Events of a key in the ``window`` seconds before each second, and the limit flag.

    Events collapse to one row per key and second before the shuffle. Time is cut into
    windows and each row also joins the next one as history, so a task sees at most two
    windows' worth of seconds of a key, however busy the key is.
    """
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    per_second = events.groupBy(key, second.alias("second")).agg(F.count(F.lit(1)).alias("events"))
    slot = F.floor(F.col("second") / window)
    doubled = per_second.withColumn("_own", slot).withColumn("_slot", F.explode(F.array(slot, slot + 1)))
    past = Window.partitionBy(key, "_slot").orderBy("second").rangeBetween(-window, -1)
    return (
        doubled.withColumn("prior", F.coalesce(F.sum("events").over(past), F.lit(0)))
        .filter("_own = _slot")
        .withColumn("over_limit", F.col("prior") >= limit)
        .drop("_own", "_slot")
    )

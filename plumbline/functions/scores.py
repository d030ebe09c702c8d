"""Trust, risk and review scoring expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import constants as K


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def weight(weights: Mapping[str, object] | None, name: str) -> Column:
    """A weight as a column; names absent from ``weights`` fall back to the default."""
    value = (weights or {}).get(name, K.DEFAULT_WEIGHTS[name])
    return value if isinstance(value, Column) else F.lit(float(value))


def weighted_sum(values: Column, weights: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)


def trust_parts(truth: Column, bias: Column, confidence: Column, weights=None) -> Column:
    """The three weighted contributions and their clamped sum, as one struct."""
    t = truth * weight(weights, "truth")
    b = (1 - bias) * weight(weights, "bias")
    c = confidence * weight(weights, "confidence")
    return F.struct(
        t.alias("truth"), b.alias("bias"), c.alias("confidence"), clamp01(t + b + c).alias("trust")
    )


def trust_score(truth: Column, bias: Column, confidence: Column, weights=None) -> Column:
    total = (
        truth * weight(weights, "truth")
        + (1 - bias) * weight(weights, "bias")
        + confidence * weight(weights, "confidence")
    )
    # greatest/least skip nulls, so an unknown signal must be kept unknown explicitly
    return F.when(total.isNotNull(), clamp01(total))


def banded(value: Column, limits: Mapping[str, float], top: str) -> Column:
    """Name of the first limit the value stays below, else ``top``; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, limit in limits.items():
        out = out.when(value < limit, name)
    return out.otherwise(top)


def risk_band(trust: Column) -> Column:
    return banded(trust, K.BANDS, "low")


def trust_level(trust: Column) -> Column:
    """The four-level scale of the product brief: 90 / 70 / 50."""
    return banded(trust, {"unsafe": 0.50, "caution": 0.70, "acceptable": 0.90}, "trusted")


def decision(trust: Column) -> Column:
    return F.when(trust >= K.APPROVE_AT, "approve").when(trust.isNotNull(), "correct")


def needs_review(trust: Column) -> Column:
    return trust < K.REVIEW_BELOW


def percent(c: Column) -> Column:
    """A 0..1 score as a whole percentage (halves to even, as Python rounds)."""
    return F.bround(c * 100, 0).cast("int")


def severity(trust: Column, bias: Column, truth: Column) -> Column:
    """Worst of the three signals; missing scores count as zero."""
    t, b, f = (F.coalesce(x, F.lit(0.0)) for x in (trust, bias, truth))
    steps = [("critical", 0.50, 0.25, 0.50), ("high", 0.60, 0.15, 0.70), ("medium", 0.75, 0.10, 0.80)]
    out = None
    for name, trust_below, bias_from, truth_below in steps:
        hit = (t < trust_below) | (b >= bias_from) | (f < truth_below)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("low")


def severity_rank(level: Column) -> Column:
    return F.when(level == "critical", 3).when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def priority(trust: Column, bias: Column, truth: Column) -> Column:
    """Severity rank in hundreds plus the weighted distance from a perfect record."""
    t, b, f = (F.coalesce(x, F.lit(0.0)) for x in (trust, bias, truth))
    gap = (1 - t) * 40 + b * 40 + (1 - f) * 20
    return F.round(severity_rank(severity(trust, bias, truth)) * 100 + gap, 2)

"""From texts to claims, verdicts and per-text roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import text as TX
from plumbline.functions.scores import clamp01


def explode_claims(df: DataFrame, keys: Sequence[str], column: str, first: int | None = None) -> DataFrame:
    """One row per claim with its position; all claims unless ``first`` asks for a report."""
    found = TX.claims(F.col(column))
    if first is not None:
        found = F.slice(found, 1, first)
    return df.select(*keys, F.posexplode(found).alias("pos", "claim"))


def normalise_verdict(c: Column) -> Column:
    """Title-case a raw verdict; anything unknown or missing becomes ``Unverifiable``."""
    shaped = F.initcap(TX.strip(c))
    return F.when(shaped.isin(list(K.VERDICT_SCORES)), shaped).otherwise(K.UNKNOWN_VERDICT)


def verdict_score(c: Column) -> Column:
    out = F.lit(K.VERDICT_SCORES[K.UNKNOWN_VERDICT])
    for verdict, score in K.VERDICT_SCORES.items():
        out = F.when(c == verdict, score).otherwise(out)
    return out


def cited(hits: Column, source_index: Column) -> Column:
    """The hit a verdict points at; an index out of range moves to the nearest hit."""
    place = F.least(F.greatest(F.coalesce(source_index, F.lit(1)), F.lit(1)), F.size(hits))
    return F.when(F.size(hits) > 0, F.element_at(hits, place))


def claim_truth(groundedness: Column, verdict: Column) -> Column:
    """Retrieval support and verdict, mixed 40 : 60."""
    return clamp01(0.4 * groundedness + 0.6 * verdict_score(verdict))


def judge(scored: DataFrame, verdict: Column | None = None, below: float = K.HALLUCINATED_BELOW) -> DataFrame:
    """Add verdict, claim truth and the hallucination flag to scored claims."""
    given = F.lit(None).cast("string") if verdict is None else verdict
    return (
        scored.withColumn("verdict", normalise_verdict(given))
        .withColumn("claim_truth", claim_truth(F.col("groundedness"), F.col("verdict")))
        .withColumn("hallucinated", F.col("claim_truth") < below)
    )


def roll_up(judged: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Per text: claim counts, hallucination rate, mean truth and groundedness."""
    return (
        judged.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_claims"),
            F.count_if("hallucinated").alias("n_hallucinated"),
            F.avg("claim_truth").alias("avg_truth"),
            F.avg("groundedness").alias("avg_groundedness"),
            F.avg(verdict_score(F.col("verdict"))).alias("avg_verdict"),
            *more,
        )
        .withColumn("hallucination_rate", F.col("n_hallucinated") / F.col("n_claims"))
        .withColumn("text_truth", clamp01(0.4 * F.col("avg_groundedness") + 0.6 * F.col("avg_verdict")))
    )

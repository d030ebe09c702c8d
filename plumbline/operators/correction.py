"""Corrections: down-weighted features, replaced claims, corrected texts, re-evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import scores
from plumbline.functions import text as TX
from plumbline.operators import claims as CL
from plumbline.operators import retrieval as R
from plumbline.operators.skew import join_to_unique

SNIPPET = 200
SOURCE_TEXT = 220
NO_CITATION = "Citation-backed fact required."


def adjust_importance(importance: Column, above: float = 0.25) -> Column:
    """Flag dominant features and halve their weight: struct(flagged, adjusted)."""
    flagged = F.map_keys(F.map_filter(importance, lambda _, v: v > above))
    adjusted = F.transform_values(importance, lambda _, v: F.round(F.when(v > above, v * 0.5).otherwise(v), 4))
    return F.struct(flagged.alias("flagged"), adjusted.alias("adjusted"))


def snippet(content: Column, chars: int = SNIPPET) -> Column:
    return TX.truncate(content, chars)


def correct_claim(claim: Column, title: Column, similarity: Column, passage: Column, at_least: float = 0.05) -> Column:
    """Replace a claim by its best citation, or mark it unverified."""
    supported = F.concat(F.lit("[CORRECTED] According to "), title, F.lit(": "), snippet(passage))
    return F.when(similarity >= at_least, supported).otherwise(F.concat(F.lit("[UNVERIFIED] "), claim))


def best_passage(scored: DataFrame, kb: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Attach title, source, similarity and passage of the first hit.

    The same passage may be the best hit of very many claims, hence the skew-safe join.
    """
    articles = kb.select(
        F.col("kb_id").alias("best_id"),
        F.col("title").alias("best_title"),
        F.col("source").alias("best_source"),
        F.substring("content", 1, SOURCE_TEXT + 1).alias("best_passage"),
    )
    first = F.element_at("hits", 1)
    picked = scored.withColumn("best_id", first["kb_id"]).withColumn("best_sim", first["sim"])
    return join_to_unique(picked, articles, "best_id", row_id)


def cite(hits: DataFrame, kb: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Hits with title, source, similarity and snippet: the citation list of each text."""
    articles = kb.select("kb_id", "title", "source", snippet(F.col("content")).alias("snippet"))
    cited = join_to_unique(hits, articles, "kb_id", [*row_id, "rank"], how="inner")
    return cited.withColumn("similarity", F.round("sim", 4)).drop("sim")


def replace_first(text: Column, claim: Column, replacement: Column) -> Column:
    """Literal replacement of the first occurrence; the text itself where there is none."""
    at = F.call_function("locate", claim, text)
    return F.when(at > 0, F.overlay(text, replacement, at, F.length(claim))).otherwise(text)


def edits() -> Column:
    """Aggregate of a text's flagged claims with their replacements, in claim order.

    The list holds pieces of that one text, so it is as bounded as the row it came from.
    """
    passage = F.substring("best_passage", 1, SOURCE_TEXT)
    replacement = F.coalesce(F.when(F.length(passage) > 0, passage), F.lit(NO_CITATION))
    edit = F.struct("pos", "claim", F.concat(F.lit("[CORRECTED] "), replacement).alias("replacement"))
    return F.sort_array(F.collect_list(F.when(F.col("hallucinated"), edit)))


def apply_edits(text: Column, edits_: Column) -> Column:
    """Replace every flagged claim by its citation, one after the other."""
    return F.aggregate(edits_, text, lambda acc, e: replace_first(acc, e["claim"], e["replacement"]))


def audit_outputs(
    outputs: DataFrame,
    keys: Sequence[str],
    column: str,
    kb: DataFrame,
    index: R.TermIndex,
    verdict: Column | None = None,
    weights=None,
) -> DataFrame:
    """Whole audit of model outputs: claims, support, verdicts, trust before and after
    correction, corrected text and the review flag. One row per output with a claim."""
    rows = [*keys, "pos"]
    claims = CL.explode_claims(outputs, keys, column)
    judged = CL.judge(R.score_claims(claims, rows, "claim", index, carry=True), verdict)
    totals = CL.roll_up(best_passage(judged, kb, rows), keys, edits().alias("edits"))
    rate, truth = F.col("hallucination_rate"), F.col("avg_truth")
    bias = F.lit(K.TEXT_NEUTRAL)
    confidence = F.greatest(F.lit(0.05), 1 - rate)
    before = scores.trust_score(truth, bias, confidence, weights)
    after = scores.trust_score(
        F.least(F.lit(1.0), truth + 0.25 * rate), bias, F.least(F.lit(1.0), confidence + 0.1), weights
    )
    return (
        totals.join(outputs, list(keys))
        .withColumn("corrected", apply_edits(F.col(column), F.col("edits")))
        .withColumn("trust_before", before)
        .withColumn("trust_after", after)
        .withColumn("trust_delta", F.col("trust_after") - F.col("trust_before"))
        .withColumn("requires_review", scores.needs_review(F.col("trust_after")))
        .drop("edits")
    )


def correct_texts(texts: DataFrame, keys: Sequence[str], column: str, kb: DataFrame, index: R.TermIndex) -> DataFrame:
    """Check each whole text as one claim and rewrite it from its best citation."""
    picked = best_passage(R.score_claims(texts, keys, column, index, carry=True), kb, keys)
    return picked.withColumn(
        "corrected",
        correct_claim(F.col(column), F.col("best_title"), F.col("best_sim"), F.col("best_passage")),
    )


def reevaluate(
    audited: DataFrame, keys: Sequence[str], index: R.TermIndex, confidence: float = K.DEFAULT_CONFIDENCE, weights=None
) -> DataFrame:
    """Second pass over audits decided ``correct``: re-verify the corrected text, ease the
    bias to 60 %, rescore. Approved audits keep their score.

    Expects ``decision``, ``corrected``, ``bias``, ``trust``.
    """
    again = R.score_claims(audited.filter(F.col("decision") == "correct"), keys, "corrected", index)
    second = again.select(*keys, F.col("truth").alias("truth_after"))
    rescored = scores.trust_score(F.col("truth_after"), F.col("bias") * 0.6, F.lit(confidence), weights)
    return (
        audited.join(second, list(keys), "left")
        .withColumn("final_trust", F.coalesce(rescored, F.col("trust")))
        .withColumn("requires_review", scores.needs_review(F.col("final_trust")))
    )

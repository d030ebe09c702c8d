"""Group fairness: rates, gaps, ratios, confusion counts and subgroup views.

Every metric is one conditional aggregate, so a hot group collapses map-side and a
dataset column in ``by`` audits many datasets in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import stats


def group_rates(df: DataFrame, outcome: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives and positive rate of every group."""
    return (
        df.groupBy(*by, group)
        .agg(F.count(F.lit(1)).alias("n"), stats.count_where(F.col(outcome) == 1).alias("positives"))
        .withColumn("rate", stats.ratio_or_zero(F.col("positives"), F.col("n")))
    )


def _agg(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def parity_gap(df, pred: str, group: str, first, second, by: Sequence[str] = ()) -> DataFrame:
    """|P(pred=1 | first) - P(pred=1 | second)|; an empty group counts as rate zero."""
    p, g = F.col(pred), F.col(group)
    rates = [
        stats.ratio_or_zero(stats.count_where((g == v) & (p == 1)), stats.count_where(g == v)).alias(name)
        for v, name in ((first, "rate_first"), (second, "rate_second"))
    ]
    return _agg(df, by, *rates).withColumn("parity_gap", F.abs(F.col("rate_first") - F.col("rate_second")))


def opportunity_gap(df, y: str, pred: str, group: str, first, second, by: Sequence[str] = ()) -> DataFrame:
    """|TPR(first) - TPR(second)|; a group without positives counts as rate zero."""
    cols = (F.col(y), F.col(pred))
    tprs = [
        stats.true_positive_rate(*cols, F.col(group) == v).alias(name)
        for v, name in ((first, "tpr_first"), (second, "tpr_second"))
    ]
    return _agg(df, by, *tprs).withColumn("opportunity_gap", F.abs(F.col("tpr_first") - F.col("tpr_second")))


def prediction_gaps(df, y: str, pred: str, group: str, first, second, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, both gaps and their mean (the bias score), in one pass."""
    a, p, g = F.col(y), F.col(pred), F.col(group)
    rate = [stats.ratio_or_zero(stats.count_where((g == v) & (p == 1)), stats.count_where(g == v)) for v in (first, second)]
    tpr = [stats.true_positive_rate(a, p, g == v) for v in (first, second)]
    out = _agg(
        df, by,
        F.avg((a == p).cast("double")).alias("accuracy"),
        F.abs(rate[0] - rate[1]).alias("demographic_parity"),
        F.abs(tpr[0] - tpr[1]).alias("equal_opportunity"),
    )
    return out.withColumn("bias_score", (F.col("demographic_parity") + F.col("equal_opportunity")) / 2)


def odds_gap(df, y: str, pred: str, group: str, first, second, by: Sequence[str] = ()) -> DataFrame:
    """Equalised-odds difference proper: the larger of the TPR gap and the FPR gap."""
    cols = (F.col(y), F.col(pred))
    aggs = []
    for v, name in ((first, "first"), (second, "second")):
        aggs.append(stats.true_positive_rate(*cols, F.col(group) == v).alias(f"tpr_{name}"))
        aggs.append(stats.false_positive_rate(*cols, F.col(group) == v).alias(f"fpr_{name}"))
    return _agg(df, by, *aggs).withColumn(
        "odds_gap",
        F.greatest(
            F.abs(F.col("tpr_first") - F.col("tpr_second")),
            F.abs(F.col("fpr_first") - F.col("fpr_second")),
        ),
    )


def confusion(df, y: str, pred: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and the rates built on them, per group."""
    a, p = F.col(y), F.col(pred)
    cells = {
        "tp": (a == 1) & (p == 1), "fp": (a == 0) & (p == 1),
        "fn": (a == 1) & (p == 0), "tn": (a == 0) & (p == 0),
    }
    counted = df.groupBy(*by, group).agg(*[stats.count_where(c).alias(n) for n, c in cells.items()])
    tp, fp, fn, tn = (F.col(c) for c in cells)
    return (
        counted.withColumn("tpr", stats.ratio_or_zero(tp, tp + fn))
        .withColumn("fpr", stats.ratio_or_zero(fp, fp + tn))
        .withColumn("accuracy", stats.ratio_or_zero(tp + tn, tp + fp + fn + tn))
    )


def _pair(rates: DataFrame, group: str, by: Sequence[str], unprivileged, privileged) -> DataFrame:
    """One row per dataset holding the two compared groups side by side."""
    aggs = [
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("positives").alias("positives"),
        F.sum("n").alias("n"),
    ]
    if unprivileged is None or privileged is None:
        order = Window.partitionBy(*by).orderBy(F.col(group).cast("string"))
        rates = rates.withColumn("_place", F.row_number().over(order))
        pick = {"unprivileged": F.col("_place") == 1, "privileged": F.col("_place") == 2}
    else:
        pick = {"unprivileged": F.col(group) == unprivileged, "privileged": F.col(group) == privileged}
    for name, cond in pick.items():
        aggs.append(F.max(F.when(cond, F.col(group).cast("string"))).alias(name))
        aggs.append(F.max(F.when(cond, F.col("rate"))).alias(f"rate_{name}"))
    return _agg(rates, by, *aggs)


def bias_metrics(
    df: DataFrame,
    label: str,
    group: str,
    unprivileged=None,
    privileged=None,
    by: Sequence[str] = (),
    compat: bool = False,
) -> DataFrame:
    """Parity difference, impact ratio and the two legal flags, one row per dataset.

    Without named groups the first two values in string order are compared. ``compat``
    reproduces the audited product's reading of a zero ratio: it is never flagged, and
    an undefined ratio counts as zero. By default total exclusion is flagged and an
    undefined ratio stays null. Where a named group has no rows the metrics are null and
    ``status`` says so.
    """
    pair = _pair(group_rates(df, label, group, by), group, by, unprivileged, privileged)
    varied = (F.col("n_groups") > 1) & (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    low, high = F.col("rate_unprivileged"), F.col("rate_privileged")
    ratio = F.try_divide(low, high)
    if compat:
        ratio = F.coalesce(ratio, F.lit(0.0))
    out = (
        pair.withColumn("parity_difference", F.when(varied, F.abs(low - high)).otherwise(0.0))
        .withColumn("impact_ratio", F.when(varied, ratio).otherwise(1.0))
        .withColumn("bias_detected", F.col("parity_difference") > K.PARITY_LIMIT)
    )
    below = F.col("impact_ratio") < K.FOUR_FIFTHS
    if compat:
        below = below & (F.col("impact_ratio") != 0)
    return out.withColumn("four_fifths_violated", F.coalesce(below, F.lit(False))).withColumn(
        "status",
        F.when(~varied, "degenerate").when(F.col("parity_difference").isNull(), "missing group").otherwise("ok"),
    )


def one_vs_rest(df: DataFrame, label: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Each group against all other rows of its dataset, for any number of groups."""
    rates = group_rates(df, label, group, by)
    everyone = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    rest_n = F.sum("n").over(everyone) - F.col("n")
    rest_pos = F.sum("positives").over(everyone) - F.col("positives")
    return (
        rates.withColumn("rate_rest", stats.ratio_or_zero(rest_pos, rest_n))
        .withColumn("gap", F.abs(F.col("rate") - F.col("rate_rest")))
        .withColumn("impact_ratio", F.try_divide(F.col("rate"), F.col("rate_rest")))
    )


def subgroup_rates(df: DataFrame, outcome: str, attributes: Sequence[str]) -> DataFrame:
    """Positive rate on every level of the cube over the protected attributes."""
    return df.cube(*attributes).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(outcome).cast("double")).alias("rate"),
    )


def top_correlated(df: DataFrame, label: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Absolute correlation of every feature with the label, and which one leads.

    All correlations come from one pass; ties go to the feature listed first.
    """
    y = F.col(label).cast("double")
    aggs = [
        F.abs(stats.correlation(F.col(c).cast("double"), y)).alias(f"_r{i}") for i, c in enumerate(features)
    ]
    wide = _agg(df, by, *aggs)
    entries = F.array(
        *[
            F.struct(F.col(f"_r{i}").alias("r"), F.lit(-i).alias("order"), F.lit(c).alias("feature"))
            for i, c in enumerate(features)
        ]
    )
    known = F.filter(entries, lambda e: e["r"].isNotNull())
    best = F.array_max(known)
    return wide.select(
        *by,
        F.map_from_entries(
            F.transform(known, lambda e: F.struct(e["feature"], e["r"]))
        ).alias("correlations"),
        best["feature"].alias("top_feature"),
        best["r"].alias("top_correlation"),
    )


def proxies(df: DataFrame, protected: str, features: Sequence[str], above: float = 0.6) -> DataFrame:
    """Features whose correlation with the protected attribute exceeds ``above``."""
    wide = top_correlated(df, protected, features)
    return wide.select(F.explode("correlations").alias("feature", "correlation")).withColumn(
        "is_proxy", F.col("correlation") > above
    )


def with_group_threshold(df, score: str, group: str, thresholds: dict, default: float = 0.5) -> DataFrame:
    """Prediction with a decision threshold of its own for chosen groups."""
    cut = F.lit(default)
    for value, threshold in thresholds.items():
        cut = F.when(F.col(group) == value, threshold).otherwise(cut)
    return df.withColumn("threshold", cut).withColumn("pred", (F.col(score) >= F.col("threshold")).cast("int"))

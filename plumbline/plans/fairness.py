"""Fairness, distribution and reweighing jobs over the decisions table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import scores
from plumbline.operators import fairness as FA
from plumbline.operators import grouped, moments, sampling
from plumbline.plans.inputs import DECISIONS, decisions
from plumbline.plans.registry import job, rounded
from plumbline.sources.tables import load

SCORECARD_SQL = f"""WITH {DECISIONS},
rates AS (SELECT dataset, segment, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, avg(label) AS rate FROM decisions GROUP BY dataset, segment),
pairs AS (
  SELECT dataset, CAST(sum(n) AS BIGINT) AS n, count(*) > 1 AND sum(positives) > 0 AND sum(positives) < sum(n) AS varied,
         max(CASE WHEN segment = 'AUTOMOBILE' THEN rate END) AS low,
         max(CASE WHEN segment = 'BUILDING' THEN rate END) AS high
  FROM rates GROUP BY dataset),
gaps AS (SELECT *, CASE WHEN varied THEN abs(low - high) ELSE 0 END AS gap, CASE WHEN varied THEN low / nullif(high, 0) ELSE 1 END AS ratio FROM pairs),
scored AS (SELECT *, CASE WHEN gap IS NOT NULL THEN greatest(0, least(1, 0.4 * 0.5 + 0.4 * (1 - gap) + 0.2 * 0.85)) END AS trust FROM gaps)
SELECT n_name AS dataset_name, n AS n_rows, round(low, 9) AS rate_unprivileged, round(high, 9) AS rate_privileged,
       round(gap, 9) AS parity_difference, round(ratio, 9) AS impact_ratio, gap > 0.1 AS bias_detected,
       coalesce(ratio < 0.8, false) AS four_fifths_violated,
       CASE WHEN NOT varied THEN 'degenerate' WHEN gap IS NULL THEN 'missing group' ELSE 'ok' END AS status, round(trust, 9) AS trust,
       CASE WHEN trust < 0.5 THEN 'critical' WHEN trust < 0.6 THEN 'elevated' WHEN trust < 0.75 THEN 'moderate' WHEN trust IS NOT NULL THEN 'low' END AS risk,
       CASE WHEN trust >= 0.7 THEN 'approve' WHEN trust IS NOT NULL THEN 'correct' END AS decision,
       trust < 0.6 AS requires_review
FROM scored JOIN nation ON n_nationkey = dataset"""


@job("trust_scorecard", "A4 C2 C3 C6 C7 C9 C13 J5", SCORECARD_SQL)
def trust_scorecard(spark, d):
    """Flagship: one trust scorecard per dataset (nation), from rows to risk band."""
    metrics = FA.bias_metrics(decisions(spark, d), "label", "segment", "AUTOMOBILE", "BUILDING", by=["dataset"])
    trust = scores.trust_score(F.lit(K.TEXT_NEUTRAL), F.col("parity_difference"), F.lit(K.DEFAULT_CONFIDENCE))
    nation = load(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("dataset_name"))
    scored = metrics.withColumn("trust", trust).join(nation, F.col("dataset") == F.col("n_nationkey"))
    return rounded(
        scored.select(
            "dataset_name", F.col("n").alias("n_rows"), "rate_unprivileged", "rate_privileged", "parity_difference",
            "impact_ratio", "bias_detected", "four_fifths_violated", "status", "trust",
            scores.risk_band(F.col("trust")).alias("risk"),
            scores.decision(F.col("trust")).alias("decision"),
            scores.needs_review(F.col("trust")).alias("requires_review"),
        )
    )


@job("group_rates", "A5 A27", f"""WITH {DECISIONS}
SELECT dataset, segment, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
       round(CAST(sum(label) AS DOUBLE) / count(*), 9) AS rate
FROM decisions GROUP BY ALL""")
def group_rates(spark, d):
    return rounded(FA.group_rates(decisions(spark, d), "label", "segment", by=["dataset"]))


@job("parity_gap", "A1", f"""WITH {DECISIONS},
r AS (SELECT dataset, coalesce(avg(pred) FILTER (segment = 'AUTOMOBILE'), 0) AS a, coalesce(avg(pred) FILTER (segment = 'BUILDING'), 0) AS b
      FROM decisions GROUP BY dataset)
SELECT dataset, round(a, 9) AS rate_first, round(b, 9) AS rate_second, round(abs(a - b), 9) AS parity_gap FROM r""")
def parity_gap(spark, d):
    return rounded(FA.parity_gap(decisions(spark, d), "pred", "segment", "AUTOMOBILE", "BUILDING", by=["dataset"]))


@job("parity_gap_per_customer", "A1", f"""WITH {DECISIONS},
r AS (SELECT custkey, coalesce(avg(pred) FILTER (label = 0), 0) AS a, coalesce(avg(pred) FILTER (label = 1), 0) AS b
      FROM decisions GROUP BY custkey)
SELECT custkey, round(a, 9) AS rate_first, round(b, 9) AS rate_second, round(abs(a - b), 9) AS parity_gap FROM r""")
def parity_gap_per_customer(spark, d):
    """Very many small datasets at once, with empty groups among them."""
    return rounded(FA.parity_gap(decisions(spark, d), "pred", "label", 0, 1, by=["custkey"]))


@job("opportunity_gap", "A2", f"""WITH {DECISIONS},
r AS (SELECT dataset, coalesce(avg(pred) FILTER (segment = 'AUTOMOBILE' AND label = 1), 0) AS a,
             coalesce(avg(pred) FILTER (segment = 'BUILDING' AND label = 1), 0) AS b
      FROM decisions GROUP BY dataset)
SELECT dataset, round(a, 9) AS tpr_first, round(b, 9) AS tpr_second, round(abs(a - b), 9) AS opportunity_gap FROM r""")
def opportunity_gap(spark, d):
    return rounded(
        FA.opportunity_gap(decisions(spark, d), "label", "pred", "segment", "AUTOMOBILE", "BUILDING", by=["dataset"])
    )


@job("bias_scan", "A7 A8", f"""WITH {DECISIONS},
r AS (SELECT dataset, coalesce(avg(pred) FILTER (segment = 'AUTOMOBILE'), 0) AS a, coalesce(avg(pred) FILTER (segment = 'BUILDING'), 0) AS b,
             coalesce(avg(pred) FILTER (segment = 'AUTOMOBILE' AND label = 1), 0) AS ta,
             coalesce(avg(pred) FILTER (segment = 'BUILDING' AND label = 1), 0) AS tb
      FROM decisions GROUP BY dataset)
SELECT dataset, round(abs(a - b), 9) AS parity_gap, round(abs(ta - tb), 9) AS opportunity_gap,
       round((abs(a - b) + abs(ta - tb)) / 2, 9) AS bias_score
FROM r""")
def bias_scan(spark, d):
    """The bias score of many datasets on given predictions, in one pass."""
    found = FA.prediction_gaps(decisions(spark, d), "label", "pred", "segment", "AUTOMOBILE", "BUILDING", by=["dataset"])
    return rounded(
        found.select(
            "dataset", F.col("demographic_parity").alias("parity_gap"), F.col("equal_opportunity").alias("opportunity_gap"), "bias_score"
        )
    )


def _fitted_rows(df):
    """A label that a linear classifier can learn in part: dear orders, the finished ones among them sooner."""
    label = (F.col("price") + F.when(F.col("label") == 1, 40000.0).otherwise(0.0) > 150000.0).cast("int")
    return df.withColumns({"dear": label, "scaled": F.col("price") / 100000, "urgent": (F.col("priority") == "1-URGENT").cast("double")})


def _newton_sql(by: str, group: str, first: str, second: str, steps: int = 14) -> str:
    """Newton steps from zero for all datasets at once, unrolled, with the inverse of each 3 x 3 system."""
    chain = ["c0 AS (SELECT key, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c FROM fit GROUP BY key HAVING min(y) < max(y))"]
    for i in range(steps):
        chain.append(f"""s{i} AS (
  SELECT key, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, sum(p - y) AS g0, sum((p - y) * x1) + any_value(b) AS g1,
    sum((p - y) * x2) + any_value(c) AS g2, sum(w) AS h00, sum(w * x1) AS h01, sum(w * x2) AS h02, sum(w * x1 * x1) + 1 AS h11, sum(w * x1 * x2) AS h12, sum(w * x2 * x2) + 1 AS h22
  FROM (SELECT *, p * (1 - p) AS w FROM (SELECT fit.*, a, b, c, 1 / (1 + exp(-(a + b * x1 + c * x2))) AS p FROM fit JOIN c{i} USING (key))) GROUP BY key),
d{i} AS (
  SELECT *, h11 * h22 - h12 * h12 AS i00, h02 * h12 - h01 * h22 AS i01, h01 * h12 - h02 * h11 AS i02, h00 * h22 - h02 * h02 AS i11, h01 * h02 - h00 * h12 AS i12, h00 * h11 - h01 * h01 AS i22,
    h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{i}),
c{i + 1} AS (
  SELECT key, a - (i00 * g0 + i01 * g1 + i02 * g2) / det AS a, b - (i01 * g0 + i11 * g1 + i12 * g2) / det AS b, c - (i02 * g0 + i12 * g1 + i22 * g2) / det AS c FROM d{i})""")
    steps_sql = ",\n".join(chain)
    return f"""WITH {DECISIONS},
fit AS (SELECT {by} AS key, {group} AS grp, CAST(price + CASE WHEN label = 1 THEN 40000 ELSE 0 END > 150000 AS INT) AS y,
  price / 100000 AS x1, CAST(priority = '1-URGENT' AS DOUBLE) AS x2 FROM decisions),
{steps_sql},
judged AS (SELECT fit.*, a, b, c, CAST(a + b * x1 + c * x2 > 0 AS INT) AS pred FROM fit LEFT JOIN c{steps} USING (key)),
r AS (SELECT key, count(*) AS n, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c,
  coalesce(avg(pred) FILTER (grp = '{first}'), 0) AS p1, coalesce(avg(pred) FILTER (grp = '{second}'), 0) AS p2,
  coalesce(avg(pred) FILTER (grp = '{first}' AND y = 1), 0) AS t1, coalesce(avg(pred) FILTER (grp = '{second}' AND y = 1), 0) AS t2 FROM judged GROUP BY key)
SELECT key AS {by}, n, round(abs(p1 - p2), 9) AS parity_gap, round(abs(t1 - t2), 9) AS opportunity_gap, round((abs(p1 - p2) + abs(t1 - t2)) / 2, 9) AS bias_score,
  round(a, 6) AS intercept, round(b, 6) AS price_weight, round(c, 6) AS urgent_weight FROM r"""


def _fitted_scan(spark, d, by, group, first, second):
    rows = _fitted_rows(decisions(spark, d))
    found = grouped.fitted_gaps(rows, [by], ["scaled", "urgent"], "dear", group, first, second, ["row_id"])
    weights = {n: F.round(F.get("coefficients", F.lit(i)), 6) for i, n in enumerate(("intercept", "price_weight", "urgent_weight"))}
    found = found.withColumnsRenamed({"demographic_parity": "parity_gap", "equal_opportunity": "opportunity_gap"})
    return rounded(found.withColumns(weights).drop("coefficients"))


@job("fitted_bias_scan", "A7 A8 M2", _newton_sql("dataset", "segment", "AUTOMOBILE", "BUILDING"))
def fitted_bias_scan(spark, d):
    """The bias score of every dataset, each judged by a classifier of its own: all are fitted side by side."""
    return _fitted_scan(spark, d, "dataset", "segment", "AUTOMOBILE", "BUILDING")


@job("fitted_scan_per_customer", "A8 M2", _newton_sql("custkey", "priority", "2-HIGH", "5-LOW"))
def fitted_scan_per_customer(spark, d):
    """Very many small datasets at once, with one label only among them."""
    return _fitted_scan(spark, d, "custkey", "priority", "2-HIGH", "5-LOW")


@job("confusion_by_group", "A3 A27", f"""WITH {DECISIONS},
c AS (SELECT dataset, segment, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
             count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn
      FROM decisions GROUP BY ALL)
SELECT *, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS tpr, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS fpr,
       round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy
FROM c""")
def confusion_by_group(spark, d):
    return rounded(FA.confusion(decisions(spark, d), "label", "pred", "segment", by=["dataset"]))


def _bias_metrics_sql(ratio: str, flag: str) -> str:
    return f"""WITH {DECISIONS},
g AS (SELECT custkey, priority, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, avg(label) AS rate,
             row_number() OVER (PARTITION BY custkey ORDER BY priority) AS place
      FROM decisions GROUP BY custkey, priority),
p AS (SELECT custkey, count(*) AS n_groups, CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS n,
             max(CASE WHEN place = 1 THEN priority END) AS unprivileged, max(CASE WHEN place = 1 THEN rate END) AS low,
             max(CASE WHEN place = 2 THEN priority END) AS privileged, max(CASE WHEN place = 2 THEN rate END) AS high
      FROM g GROUP BY custkey),
m AS (SELECT *, n_groups > 1 AND positives > 0 AND positives < n AS varied FROM p),
q AS (SELECT *, CASE WHEN varied THEN abs(low - high) ELSE 0 END AS gap, CASE WHEN varied THEN {ratio} ELSE 1 END AS ratio FROM m)
SELECT custkey, n_groups, positives, n, unprivileged, round(low, 9) AS rate_unprivileged, privileged,
       round(high, 9) AS rate_privileged, round(gap, 9) AS parity_difference, round(ratio, 9) AS impact_ratio,
       gap > 0.1 AS bias_detected, coalesce({flag}, false) AS four_fifths_violated,
       CASE WHEN varied THEN 'ok' ELSE 'degenerate' END AS status
FROM q"""


@job("bias_metrics", "A4", _bias_metrics_sql("low / nullif(high, 0)", "ratio < 0.8"))
def bias_metrics(spark, d):
    """Groups by the sorted rule, one dataset per customer; total exclusion is flagged."""
    return rounded(FA.bias_metrics(decisions(spark, d), "label", "priority", by=["custkey"]))


@job("bias_metrics_compat", "A4", _bias_metrics_sql("coalesce(low / nullif(high, 0), 0)", "ratio < 0.8 AND ratio <> 0"))
def bias_metrics_compat(spark, d):
    """As above, with a zero ratio read as 'no finding'."""
    return rounded(FA.bias_metrics(decisions(spark, d), "label", "priority", by=["custkey"], compat=True))


@job("one_vs_rest", "A4", f"""WITH {DECISIONS},
g AS (SELECT dataset, segment, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM decisions GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w - n AS rn, sum(positives) OVER w - positives AS rp FROM g WINDOW w AS (PARTITION BY dataset))
SELECT dataset, segment, n, positives, round(positives / n, 9) AS rate, round(coalesce(rp / nullif(rn, 0), 0), 9) AS rate_rest,
       round(abs(positives / n - coalesce(rp / nullif(rn, 0), 0)), 9) AS gap,
       round((positives / n) / nullif(coalesce(rp / nullif(rn, 0), 0), 0), 9) AS impact_ratio
FROM r""")
def one_vs_rest(spark, d):
    return rounded(FA.one_vs_rest(decisions(spark, d), "label", "segment", by=["dataset"]))


@job("subgroup_rates", "A12", f"""WITH {DECISIONS}
SELECT segment, priority, CAST(grouping_id(segment, priority) AS BIGINT) AS level, count(*) AS n, round(avg(label), 9) AS rate
FROM decisions GROUP BY CUBE (segment, priority)""")
def subgroup_rates(spark, d):
    return rounded(FA.subgroup_rates(decisions(spark, d), "label", ["segment", "priority"]))


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@job("top_correlated", "A6", """WITH l AS (SELECT *, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem),
c AS (SELECT l_linestatus, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
             unnest([abs(corr(l_quantity, y)), abs(corr(l_extendedprice, y)), abs(corr(l_discount, y)), abs(corr(l_tax, y))]) AS r
      FROM l GROUP BY l_linestatus)
SELECT l_linestatus, feature, round(r, 9) AS correlation, r = max(r) OVER (PARTITION BY l_linestatus) AS is_top FROM c""")
def top_correlated(spark, d):
    lines = load(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    found = FA.top_correlated(lines, "y", LINE_FEATURES, by=["l_linestatus"])
    long = found.select("l_linestatus", "top_feature", F.explode("correlations").alias("feature", "correlation"))
    return rounded(long.withColumn("is_top", F.col("feature") == F.col("top_feature")).drop("top_feature"))


@job("protected_proxies", "D1", """WITH l AS (SELECT *, CAST(l_linestatus = 'O' AS INT) AS p FROM lineitem)
SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
       unnest([round(abs(corr(l_quantity, p)), 9), round(abs(corr(l_extendedprice, p)), 9), round(abs(corr(l_discount, p)), 9), round(abs(corr(l_tax, p)), 9)]) AS correlation,
       unnest([abs(corr(l_quantity, p)) > 0.6, abs(corr(l_extendedprice, p)) > 0.6, abs(corr(l_discount, p)) > 0.6, abs(corr(l_tax, p)) > 0.6]) AS is_proxy
FROM l""")
def protected_proxies(spark, d):
    lines = load(spark, d, "lineitem").withColumn("p", (F.col("l_linestatus") == "O").cast("int"))
    return rounded(FA.proxies(lines, "p", LINE_FEATURES))


@job("equalised_odds", "D2", f"""WITH {DECISIONS},
r AS (SELECT dataset,
  coalesce(avg(pred) FILTER (segment = 'AUTOMOBILE' AND label = 1), 0) AS ta, coalesce(avg(pred) FILTER (segment = 'AUTOMOBILE' AND label = 0), 0) AS fa,
  coalesce(avg(pred) FILTER (segment = 'BUILDING' AND label = 1), 0) AS tb, coalesce(avg(pred) FILTER (segment = 'BUILDING' AND label = 0), 0) AS fb
  FROM decisions GROUP BY dataset)
SELECT dataset, round(ta, 9) AS tpr_first, round(fa, 9) AS fpr_first, round(tb, 9) AS tpr_second, round(fb, 9) AS fpr_second,
       round(greatest(abs(ta - tb), abs(fa - fb)), 9) AS odds_gap
FROM r""")
def equalised_odds(spark, d):
    return rounded(FA.odds_gap(decisions(spark, d), "label", "pred", "segment", "AUTOMOBILE", "BUILDING", by=["dataset"]))


@job("text_label_fairness", "A2 A3 A5", """WITH t AS (SELECT lang, quality AS y, 1 - toxic AS pred FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
             count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM t GROUP BY lang)
SELECT *, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS tpr, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS fpr,
       round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM c""")
def text_label_fairness(spark, d):
    """A toxicity filter judged against quality labels, per language."""
    docs = load(spark, d, "documents").select("doc_id", "lang")
    rows = load(spark, d, "labels").join(docs, "doc_id").select(
        "lang", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("pred")
    )
    return rounded(FA.confusion(rows, "y", "pred", "lang"))


@job("group_thresholds", "D8", f"""WITH {DECISIONS}
SELECT segment, count(*) AS n, CAST(sum(CAST(least(price / 400000, 1) >= CASE WHEN segment = 'AUTOMOBILE' THEN 0.4 ELSE 0.5 END AS INT)) AS BIGINT) AS positives,
       round(avg(CAST(least(price / 400000, 1) >= CASE WHEN segment = 'AUTOMOBILE' THEN 0.4 ELSE 0.5 END AS INT)), 9) AS rate
FROM decisions GROUP BY segment""")
def group_thresholds(spark, d):
    scored = decisions(spark, d).withColumn("score", F.least(F.col("price") / 400000, F.lit(1.0)))
    return rounded(FA.group_rates(FA.with_group_threshold(scored, "score", "segment", {"AUTOMOBILE": 0.4}), "pred", "segment"))


def _moments_sql(table: str, by: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT {by}, '{c}' AS "column", count({c}) AS n, avg({c}) AS mean,
       CASE WHEN count({c}) > 1 THEN stddev_samp({c}) ELSE 0 END AS std,
       CASE WHEN count({c}) < 3 THEN 0 ELSE skewness({c}) END AS skewness,
       CASE WHEN count({c}) < 4 THEN 0 ELSE kurtosis({c}) END AS kurtosis
FROM {table} GROUP BY {by}"""
        for c in columns
    ]
    return f"""SELECT {by}, "column", n, round(mean, 6) AS mean, round(std, 6) AS std, round(skewness, 6) AS skewness,
       round(kurtosis, 6) AS kurtosis,
       CASE WHEN n < 4 THEN CAST(0.5 AS DOUBLE) WHEN skewness IS NOT NULL THEN round(1 - least((abs(skewness) + abs(kurtosis) / 3) / 4, CAST(1 AS DOUBLE)), 6) END AS stability
FROM ({' UNION ALL '.join(parts)})"""


def _moments(df, columns, by):
    return rounded(moments.distribution_report(df, columns, by), 6)


@job("distribution_report", "A10 A11", _moments_sql("lineitem", "l_returnflag", LINE_FEATURES))
def distribution_report(spark, d):
    return _moments(load(spark, d, "lineitem"), LINE_FEATURES, ["l_returnflag"])


@job("distribution_per_customer", "A10 A11", f"""WITH {DECISIONS} {_moments_sql('decisions', 'custkey', ['price'])}""")
def distribution_per_customer(spark, d):
    """Small datasets: fewer than four values, where the moments have fixed answers."""
    return _moments(decisions(spark, d), ["price"], ["custkey"])


@job("joint_probabilities", "A12 J9", f"""WITH {DECISIONS},
c AS (SELECT segment, label, count(*) AS n FROM decisions GROUP BY ALL)
SELECT segment, label, n, round(n / sum(n) OVER (), 9) AS p_joint,
       round(sum(n) OVER (PARTITION BY segment) / sum(n) OVER (), 9) AS p_group,
       round(sum(n) OVER (PARTITION BY label) / sum(n) OVER (), 9) AS p_label
FROM c""")
def joint_probabilities(spark, d):
    return rounded(sampling.joint_probabilities(decisions(spark, d), "segment", "label"))


REWEIGH = """c AS (SELECT l_linestatus, CAST(l_returnflag = 'R' AS INT) AS y, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT l_linestatus, y, n,
  (sum(n) OVER (PARTITION BY l_linestatus) / sum(n) OVER ()) * (sum(n) OVER (PARTITION BY y) / sum(n) OVER ())
    / (n / sum(n) OVER () + 1e-9)
    * CASE WHEN (l_linestatus = 'O' AND y = 1) OR (l_linestatus <> 'O' AND y = 0) THEN 3.0 ELSE 0.5 END AS weight
  FROM c)"""


@job("reweighing_weights", "A13", f"""WITH {REWEIGH}
SELECT l_linestatus, y, n, round(weight, 9) AS weight FROM w""")
def reweighing_weights(spark, d):
    lines = load(spark, d, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    cells = sampling.reweigh_table(lines, "l_linestatus", "y", "O")
    return rounded(cells.select("l_linestatus", "y", "n", "weight"))


@job("reweighed_rates", "A13 J9", f"""WITH {REWEIGH}
SELECT l_linestatus, round(sum(n * weight), 2) AS weighted_rows, round(sum(n * weight * y) / sum(n * weight), 6) AS weighted_rate
FROM w GROUP BY l_linestatus""")
def reweighed_rates(spark, d):
    """Weights attached to every row, then the positive rate they lead to."""
    lines = load(spark, d, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    rows = sampling.reweigh(lines, "l_linestatus", "y", "O")
    total = F.sum("weight")
    return rows.groupBy("l_linestatus").agg(
        F.round(total, 2).alias("weighted_rows"), F.round(F.sum(F.col("weight") * F.col("y")) / total, 6).alias("weighted_rate")
    )


@job("stratum_replication", "A14 U1", f"""WITH {DECISIONS},
r AS (SELECT segment, label, 1 + CASE WHEN segment = 'BUILDING' AND label = 1 THEN 10 ELSE 0 END
                              + CASE WHEN segment = 'AUTOMOBILE' AND label = 0 THEN 10 ELSE 0 END AS copies FROM decisions)
SELECT segment, label, CAST(sum(copies) AS BIGINT) AS n FROM r GROUP BY ALL""")
def stratum_replication(spark, d):
    seg, y = F.col("segment"), F.col("label")
    strata = [((seg == "BUILDING") & (y == 1), 10), ((seg == "AUTOMOBILE") & (y == 0), 10)]
    rows = sampling.replicate(decisions(spark, d).select("segment", "label"), strata)
    return rows.groupBy("segment", "label").agg(F.count(F.lit(1)).alias("n"))


@job("hash_split", "M9")
def hash_split(spark, d):
    """Sizes and label rates of the two parts of a stable split."""
    parts = sampling.hash_split(decisions(spark, d), "row_id")
    return parts.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"))

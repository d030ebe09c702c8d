"""Model-based jobs. Fits differ between solvers, so these have no SQL equivalent; the
tests check their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import audit as AU
from plumbline.operators import fairness as FA
from plumbline.operators import models as M
from plumbline.plans.inputs import DECISIONS, decisions
from plumbline.plans.registry import job, rounded
from plumbline.session import scratch_path
from plumbline.sources.tables import load

FEATURES = ["linestatus", "quantity", "discount", "tax"]


def _lines(spark, d):
    lines = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linestatus") == "O").cast("int").alias("linestatus"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") > 38000).cast("int").alias("label"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
    )
    return M.spread(lines)


def _encoded_decisions(spark, d):
    rows = decisions(spark, d)
    return M.census_features(rows, ["price", "balance"], ["segment", "priority"]).transform(M.spread(rows))


@job("fitted_bias_score", "A7 M2")
def fitted_bias_score(spark, d):
    """Gaps of a linear classifier's own predictions."""
    found = M.bias_score(_lines(spark, d), FEATURES, "label", "linestatus", ["row_id"])
    return spark.createDataFrame([(found["bias"], found["parity"], found["opportunity"])], "bias double, parity double, opportunity double")


@job("permutation_importance", "M3")
def permutation_importance(spark, d):
    ready = M.assemble(_lines(spark, d), FEATURES)
    return M.permutation_importance(ready, FEATURES, "label", M.fit_linear(ready, "label"), ["row_id"])


@job("clusters", "M1")
def clusters(spark, d):
    found = M.cluster(_lines(spark, d), ["quantity", "discount", "tax"])
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("quantity").alias("mean_quantity"))


@job("cluster_fairness", "A15 M1 M2")
def cluster_fairness(spark, d):
    overall, details = M.cluster_bias(_lines(spark, d), FEATURES, "label", "linestatus")
    rows = [(x["cluster"], x["size"], x["parity_gap"], overall) for x in details]
    return spark.createDataFrame(rows, "cluster int, size bigint, parity_gap double, overall double")


@job("cluster_gaps", "A15")
def cluster_gaps(spark, d):
    """Parity of a given prediction column within clusters, in one grouped pass."""
    found = M.cluster(_lines(spark, d), ["quantity", "discount", "tax"]).withColumn("pred", (F.col("quantity") > 25).cast("int"))
    return M.cluster_gaps(found, "pred", "linestatus")


@job("census_slots", "P10", f"""WITH {DECISIONS},
names AS (SELECT 'price' AS name UNION ALL SELECT 'balance'
  UNION ALL SELECT 'segment_kept_' || segment FROM (SELECT DISTINCT segment FROM decisions) WHERE segment > (SELECT min(segment) FROM decisions)
  UNION ALL SELECT 'priority_kept_' || priority FROM (SELECT DISTINCT priority FROM decisions) WHERE priority > (SELECT min(priority) FROM decisions))
SELECT name FROM names""")
def census_slots(spark, d):
    """The slots of the feature vector: each categorical column lacks its first level."""
    return spark.createDataFrame([(n,) for n in M.feature_names(_encoded_decisions(spark, d))], "name string")


@job("trained_model", "M4 M9 A27 P10")
def trained_model(spark, d):
    """Fit on the training part, save, load, and judge on the rest."""
    from plumbline.operators.sampling import hash_split

    rows = hash_split(_encoded_decisions(spark, d), "row_id")
    path = scratch_path(spark, "model")
    M.save(M.train(rows.filter("is_train"), "label"), path)
    held = M.predict(M.load(path), rows.filter("NOT is_train"))
    return held.agg(M.accuracy("label", "pred").alias("accuracy"), F.count(F.lit(1)).alias("n"))


@job("predictions", "M6")
def predictions(spark, d):
    rows = _encoded_decisions(spark, d)
    return M.predict(M.train(rows, "label"), rows).select("row_id", "pred", "score")


@job("model_fairness", "A9 A5")
def model_fairness(spark, d):
    """Both gaps of the deployed model over the whole table."""
    rows = _encoded_decisions(spark, d)
    return FA.prediction_gaps(M.predict(M.train(rows, "label"), rows), "label", "pred", "segment", "AUTOMOBILE", "BUILDING")


@job("model_comparison", "A16 M5 U5")
def model_comparison(spark, d):
    return rounded(M.compare_models(_encoded_decisions(spark, d), "row_id", "label", "segment", "AUTOMOBILE", "BUILDING"), 4)


@job("mitigated_model", "M8 A13")
def mitigated_model(spark, d):
    return rounded(M.mitigate(_encoded_decisions(spark, d), "row_id", "label", "segment", "AUTOMOBILE", "BUILDING"), 4)


@job("row_explanations", "M7 T6")
def row_explanations(spark, d):
    ready = M.assemble(_lines(spark, d), FEATURES)
    return M.explain_rows(M.train(ready, "label"), ready, FEATURES, ["row_id"])


IMPACTS = """i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  0.8::DOUBLE * (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS q,
  -0.5::DOUBLE * (l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER () AS d,
  0.01::DOUBLE * (l_tax - avg(l_tax) OVER ()) / stddev_samp(l_tax) OVER () AS t FROM lineitem),
m AS (SELECT *, greatest(abs(q), abs(d), abs(t)) AS top FROM i)"""


@job("ranked_contributions", "T6", f"""WITH {IMPACTS},
u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, top, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([q, d, t]) AS impact FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, feature, round(impact, 6) AS impact, round(abs(impact) / top, 6) AS share
FROM u WHERE abs(impact) > 0.03""")
def ranked_contributions(spark, d):
    """Impacts of a linear model with given coefficients on standardised columns."""
    lines = load(spark, d, "lineitem")
    names, coef = ["quantity", "discount", "tax"], [0.8, -0.5, 0.01]
    s = lines.agg(*[f(f"l_{n}").alias(f"{a}_{n}") for n in names for f, a in ((F.avg, "m"), (F.stddev_samp, "s"))]).first()
    impacts = F.array(*[F.lit(c) * (F.col(f"l_{n}") - s[f"m_{n}"]) / s[f"s_{n}"] for n, c in zip(names, coef)])
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(lines.select(*keys, F.inline(M.contributions(impacts, names))), 6)


@job("table_audit", "C11 P7 P11 P12 U3 A6 A11 C3 C7 C8 C10")
def table_audit(spark, d):
    """The whole dataset audit of one table: metrics, trust, decision, flags."""
    segment = F.when(F.col("segment") == "AUTOMOBILE", "AUTOMOBILE").otherwise("OTHER")
    rows = decisions(spark, d).withColumn("segment", segment)
    return AU.audit_table(rows, ["price", "balance", "priority"], "label", "segment", ["row_id"])

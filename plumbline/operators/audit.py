"""The whole dataset audit: encode, measure, score, decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import constants as K
from plumbline.functions import scores
from plumbline.operators import encode, fairness, models, moments, rules

DEPTHS = ("fast", "standard", "thorough")


def encode_mixed(df: DataFrame, features: Sequence[str], target: str, protected: str) -> DataFrame:
    """Text columns as sorted codes, numbers made finite, target as 0/1."""
    out = df
    for c in dict.fromkeys([*features, protected]):
        if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType)):
            out = encode.label_encode(out, c, f"_{c}").drop(c).withColumnRenamed(f"_{c}", c)
        else:
            out = out.withColumn(c, encode.finite(F.col(c)))
    codes = encode.value_codes(out, target).limit(3).count()
    if codes > 2:
        return encode.binarise_by_median(out, target, "_y").drop(target).withColumnRenamed("_y", target)
    return encode.label_encode(out, target, "_y").drop(target).withColumnRenamed("_y", target)


def audit_table(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    protected: str,
    row_id: Sequence[str],
    truth: float | None = None,
    description: str = "",
    depth: str = "standard",
    clusters: int = K.CLUSTERS,
    weights=None,
) -> DataFrame:
    """One row of results for one table.

    ``truth`` is the support of the table's description, where it has been checked; without
    it the signal is neutral and marked so. An unknown depth counts as standard; a fast
    audit skips the cluster and distribution checks.
    """
    depth = depth if depth in DEPTHS else "standard"
    names = list(dict.fromkeys([protected, *features]))
    ready = encode_mixed(df.select(*row_id, *names, target), features, target, protected).persist()
    bias = models.bias_score(ready, names, target, protected, row_id)
    if depth == "fast":
        cluster, shape = K.FAST_CLUSTER, K.FAST_DISTRIBUTION
    else:
        cluster, _ = models.cluster_bias(ready, names, target, protected, clusters)
        shape = moments.distribution_report(ready, [target]).first()["stability"]
    metrics = fairness.bias_metrics(ready, target, protected).drop("n_groups", "positives", "n", "status")
    lead = fairness.top_correlated(ready, target, names).first()
    n = ready.count()
    row = metrics.withColumns(
        {
            "n_rows": F.lit(n),
            "bias": F.lit(float(bias["bias"])),
            "demographic_parity": F.lit(float(bias["parity"])),
            "equal_opportunity": F.lit(float(bias["opportunity"])),
            "feature_importance": F.create_map(*[F.lit(x) for kv in sorted(bias["importance"].items()) for x in kv]),
            "cluster_fairness": F.lit(float(cluster)),
            "stability": F.lit(shape).cast("double"),
            "top_feature": F.lit(lead["top_feature"]),
            "truth": F.lit(K.TEXT_NEUTRAL if truth is None else float(truth)),
            "truth_status": F.lit("not checked" if truth is None else "checked"),
            "depth": F.lit(depth),
        }
    )
    trust = scores.trust_score(F.col("truth"), F.col("bias"), F.lit(K.DEFAULT_CONFIDENCE), weights)
    row = row.withColumn("trust", trust).withColumn("decision", scores.decision(F.col("trust")))
    eased = scores.trust_score(F.col("truth"), F.col("bias") * 0.6, F.lit(K.DEFAULT_CONFIDENCE), weights)
    redo = (F.col("decision") == "correct") & (F.lit(depth) != "fast")
    return row.withColumn("final_trust", F.when(redo, eased).otherwise(F.col("trust"))).withColumns(
        {
            "risk": scores.risk_band(F.col("final_trust")),
            "requires_review": scores.needs_review(F.col("final_trust")),
            "flags": rules.regulatory_flags(
                F.col("bias"), F.col("truth"), F.lit(description), F.col("cluster_fairness"), F.col("stability"),
                uses_zip=F.lit("zip_code" in names),
            ),
        }
    )

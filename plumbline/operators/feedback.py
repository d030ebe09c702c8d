"""Human feedback: history, proposed weights, retrain trigger."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import scores


def with_feedback(audits: DataFrame, feedback: DataFrame) -> DataFrame:
    """Audits with the number of feedback entries they drew."""
    per_audit = feedback.groupBy("audit_id").agg(F.count(F.lit(1)).alias("n_feedback"))
    return audits.join(per_audit, "audit_id", "left").fillna(0, ["n_feedback"])


def propose_weights(feedback: DataFrame, share: float = 0.3, step: float = 0.05, cap: float = 0.5) -> DataFrame:
    """Raise the bias or truth weight where users complain often, and rescale to one."""
    ratios = feedback.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("bias_flag").cast("int")).alias("bias_ratio"),
        F.avg((~F.col("correct")).cast("int")).alias("incorrect_ratio"),
    )

    def raised(name: str, ratio: str):
        base = K.DEFAULT_WEIGHTS[name]
        return F.when(F.col(ratio) > share, min(base + step, cap)).otherwise(base)

    raw = ratios.withColumn("truth", raised("truth", "incorrect_ratio")).withColumn("bias", raised("bias", "bias_ratio"))
    raw = raw.withColumn("confidence", F.lit(K.DEFAULT_WEIGHTS["confidence"]))
    total = F.col("truth") + F.col("bias") + F.col("confidence")
    return raw.withColumn("_total", total).withColumns(
        {n: F.round(F.col(n) / F.col("_total"), 4) for n in ("truth", "bias", "confidence")}
    ).drop("_total")


def retrain_due(feedback: DataFrame, every: int = 5) -> DataFrame:
    """True each time another ``every`` entries have come in."""
    n = F.count(F.lit(1))
    return feedback.agg(n.alias("n"), ((n > 0) & (n % every == 0)).alias("retrain"))


def append_feedback(path: str, batch: DataFrame, every: int = 5) -> DataFrame:
    """Append a batch of entries to the stored ones, and say whether to train again.

    The history is counted before and after, from file footers, so a batch that passes
    several multiples of ``every`` tells how many: as often as its entries one by one would have. A batch without rows appends nothing.
    """
    spark = batch.sparkSession

    def stored() -> int:
        return spark.read.schema(batch.schema).parquet(path).count()

    try:
        before = stored()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        before = 0
    batch.write.mode("append").parquet(path)
    n = stored()
    due = n // every - before // every
    return spark.createDataFrame([(before, n, due, due > 0)], "n_before bigint, n bigint, n_due bigint, retrain boolean")


def check_weights(proposals: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Validate custom weights: each within 0..1, sum near one; then scale to four places."""
    names = ("truth", "bias", "confidence")
    total = F.col("truth") + F.col("bias") + F.col("confidence")
    in_range = F.col("truth").between(0, 1) & F.col("bias").between(0, 1) & F.col("confidence").between(0, 1)
    return (
        proposals.withColumn("total", total)
        .withColumn("valid", in_range & (F.abs(F.col("total") - 1) <= tolerance))
        .withColumns({f"{n}_scaled": F.when(F.col("valid"), F.round(F.col(n) / F.col("total"), 4)) for n in names})
    )


def presets(spark) -> DataFrame:
    """The four weight presets, one row each."""
    rows = [(name, w["truth"], w["bias"], w["confidence"]) for name, w in K.PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, w_truth double, w_bias double, w_confidence double")


def score_under_presets(df: DataFrame, truth: str, bias: str, confidence: str) -> DataFrame:
    """One row per input row and preset. The preset list is a literal array, so rows are
    multiplied in place without a join."""
    options = F.array(
        *[F.struct(F.lit(n).alias("preset"), *[F.lit(v).alias(f"w_{k}") for k, v in w.items()]) for n, w in K.PRESETS.items()]
    )
    spread = df.withColumn("_p", F.explode(options))
    weights = {k: F.col(f"_p.w_{k}") for k in ("truth", "bias", "confidence")}
    return (
        spread.withColumn("preset", F.col("_p.preset"))
        .withColumn("trust", scores.trust_score(F.col(truth), F.col(bias), F.col(confidence), weights))
        .drop("_p")
    )

"""Reweighing, stratum replication and hash splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.operators.skew import small_enough


def joint_probabilities(df: DataFrame, group: str, label: str) -> DataFrame:
    """P(group, label) with both marginals, from one grouped count."""
    cells = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return (
        cells.withColumn("p_joint", F.col("n") / total)
        .withColumn("p_group", F.sum("n").over(Window.partitionBy(group)) / total)
        .withColumn("p_label", F.sum("n").over(Window.partitionBy(label)) / total)
    )


def reweigh_table(
    df: DataFrame,
    group: str,
    label: str,
    protected_value,
    factors: Mapping[tuple[int, int], float] | None = None,
) -> DataFrame:
    """Weight of each (group, label) cell; factors of 1.0 give textbook reweighing.

    ``factors`` is keyed by (is protected, label).
    """
    factors = K.REWEIGH_FACTORS if factors is None else factors
    cells = joint_probabilities(df, group, label)
    is_protected = (F.col(group) == protected_value).cast("int")
    factor = F.lit(1.0)
    for (g, y), value in factors.items():
        factor = F.when((is_protected == g) & (F.col(label) == y), value).otherwise(factor)
    fair = F.col("p_group") * F.col("p_label") / (F.col("p_joint") + 1e-9)
    return cells.withColumn("weight", fair * factor)


def reweigh(df, group: str, label: str, protected_value, factors=None) -> DataFrame:
    """Attach the cell weight to every row; the weight table has one row per cell."""
    weights = reweigh_table(df, group, label, protected_value, factors).select(group, label, "weight")
    return df.join(F.broadcast(weights) if small_enough(weights) else weights, [group, label], "left")


def replicate(df: DataFrame, strata: Sequence[tuple[Column, int]]) -> DataFrame:
    """Base rows plus ``extra`` copies of every row in each stratum."""
    copies = F.lit(1)
    for cond, extra in strata:
        copies = copies + F.when(cond, extra).otherwise(0)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))


def hash_split(df: DataFrame, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Mark training rows by a hash of the key: stable under any partitioning."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    return df.withColumn("is_train", place < int(train * 10_000))

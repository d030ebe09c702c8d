"""Distribution shape: mean, deviation, skewness, kurtosis, stability; exact medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import stats


def distribution_report(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and dataset): the sample moments and the stability score."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(0.0).alias("std"),
                stats.sample_skewness(x).alias("skewness"),
                stats.sample_kurtosis(x).alias("kurtosis"),
            ).alias(f"_{c}")
        )
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = wide.select(*by, F.inline(F.array(*[F.col(f"`_{c}`") for c in columns])))
    return rows.withColumn("stability", stats.stability(F.col("n"), F.col("skewness"), F.col("kurtosis")))


def medians(df: DataFrame, columns: Sequence[str], bins: int = 256) -> dict[str, float | None]:
    """Exact median of each column; the two middle values are averaged, nulls and NaN left out.

    The interval that holds a middle rank is narrowed by counting rows in equal slots, for all columns and ranks
    in one pass each time, until a slot holds a single value. A pass returns ``bins`` rows per rank at most.
    Infinities count as values but take no part in the narrowing.
    """
    if not columns:
        return {}
    inf = float("inf")
    cells = [F.col(c).cast("double") for c in columns]
    cells = [F.when(~F.isnan(x), x) for x in cells]
    finite = [F.when(F.abs(x) < inf, x) for x in cells]
    head = df.agg(
        *[F.count(x).alias(f"n_{i}") for i, x in enumerate(cells)],
        *[F.count_if(x == -inf).alias(f"low_{i}") for i, x in enumerate(cells)],
        *[F.count(x).alias(f"finite_{i}") for i, x in enumerate(finite)],
        *[F.min(x).alias(f"lo_{i}") for i, x in enumerate(finite)],
        *[F.max(x).alias(f"hi_{i}") for i, x in enumerate(finite)],
    ).first()
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[int, float, float]] = {}  # rank within [lo, hi], lo, hi
    for i in range(len(columns)):
        n, low, inner = head[f"n_{i}"], head[f"low_{i}"], head[f"finite_{i}"]
        for rank in {(n - 1) // 2, n // 2} if n else ():
            if low <= rank < low + inner:
                open_[i, rank] = (rank - low, head[f"lo_{i}"], head[f"hi_{i}"])
            else:
                found[i, rank] = -inf if rank < low else inf
    while open_:
        found |= {k: lo for k, (_, lo, hi) in open_.items() if lo == hi}
        open_ = {k: state for k, state in open_.items() if state[1] < state[2]}
        if open_:
            open_ = _narrowed(df, finite, open_, bins)
    out: dict[str, float | None] = {}
    for i, c in enumerate(columns):
        middle = [x for (j, _), x in sorted(found.items()) if j == i]
        # two middles of opposite infinity have no mean: NaN
        out[c] = middle[0] / 2 + middle[-1] / 2 if middle else None
    return out


def _narrowed(df: DataFrame, finite: Sequence[Column], open_: dict, bins: int) -> dict:
    """One pass over the table: for each open rank, the slot that holds it and its rank there."""
    keys = list(open_)
    places = []
    for at, (i, rank) in enumerate(keys):
        _, lo, hi = open_[i, rank]
        x, width = finite[i], hi / bins - lo / bins
        if lo + width > lo:
            far = hi - lo == float("inf")
            slot = F.floor(x / width - lo / width if far else (x - lo) / width)
            slot = F.least(slot, F.lit(bins - 1)).cast("double")
        else:  # the step is too small to move lo: the few values left are their own slots
            slot = x
        places.append(F.when(x.between(lo, hi), F.struct(F.lit(at).alias("at"), slot.alias("slot"), x.alias("x"))))
    rows = df.select(F.explode(F.array_compact(F.array(*places))).alias("p")).select("p.*")
    counted = rows.groupBy("at", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    after = {}
    for row in counted.orderBy("at", "slot").collect():  # at most `bins` rows per open rank
        key = keys[row["at"]]
        if key in after:
            continue
        left = open_[key][0]
        if left < row["n"]:
            after[key] = (left, row["lo"], row["hi"])
        else:
            open_[key] = (left - row["n"], *open_[key][1:])
    return after

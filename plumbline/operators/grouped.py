"""Logistic fits of very many small or large groups at once, by Newton steps over one aggregate per step.

Every group has its own coefficients, in a table with one row per group. A step joins the rows to it, sums each
group's loss, gradient and Gram matrix in one grouped aggregate, and solves all groups' systems in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import fairness
from plumbline.operators.encode import finite
from plumbline.operators.skew import join_to_unique, small_enough
from plumbline.session import materialise

STEPS = 40
# A group is done once no coefficient moves by more than this share.
TOLERANCE = 1e-10
# A group of up to this many rows is fitted in one task, with many others at once.
SMALL_ROWS = 256


def _steps(size: int, penalty: float):
    """The next coefficients to try of each group: a Newton step, or half of the last where the loss rose."""
    names = [f"{part}{i}" for part in "tbd" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy()
            take = lambda part: np.stack([column(f"{part}{i}") for i in range(size)], axis=1)
            tried, best, step = take("t"), take("b"), take("d")
            shrink = np.array([0.0] + [penalty] * (size - 1))  # the intercept is free
            loss = column("loss") + 0.5 * (shrink * tried**2).sum(axis=1)
            gradient = take("g") + shrink * tried
            gram = np.empty((len(tried), size, size))
            for i in range(size):
                for j in range(i + 1):
                    gram[:, i, j] = gram[:, j, i] = column(f"h{i}_{j}")
            # a little on the diagonal keeps saturated groups solvable
            gram += np.diag(np.maximum(shrink, 1e-12))
            lowest = column("lowest")
            better = loss <= lowest + 1e-12 * np.abs(lowest)
            newton = -np.linalg.solve(gram, gradient[:, :, None])[:, :, 0] if len(gram) else step
            best = np.where(better[:, None], tried, best)
            step = np.where(better[:, None], newton, step / 2)
            done = (np.abs(step) <= TOLERANCE * (1 + np.abs(best))).all(axis=1)
            columns = [*(best + step).T, *best.T, *step.T]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns), pa.array(np.where(better, loss, lowest)), pa.array(done)],
                ["_key", *names, "lowest", "done"],
            )

    return names, run


def _fit_small(rows: DataFrame, names: Sequence[str], columns: Sequence[str], run, schema: T.StructType, steps: int) -> DataFrame:
    """The last state of every group with both labels; each group's rows meet once, in one cell of bounded size."""
    packed = rows.groupBy("_key").agg(F.collect_list(F.struct("y", *names)).alias("rows"))
    size = len(names) + 1

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, flat = batch.column(1), batch.column(1).flatten()
            y = flat.field(0).to_numpy()
            x = np.stack([np.ones(len(y)), *(flat.field(i).to_numpy() for i in range(1, size))], axis=1)
            counts = lists.value_lengths().to_numpy()
            starts = np.cumsum(counts) - counts
            if not len(counts):
                continue
            open_ = np.minimum.reduceat(y, starts) < np.maximum.reduceat(y, starts)
            zeros = np.zeros((batch.num_rows, size))
            parts = [batch.column(0), *zeros.T, *zeros.T, *zeros.T, np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows, bool)]
            state = pa.RecordBatch.from_arrays([pa.array(c) for c in parts], schema.names)
            for step in range(steps + 1):
                if step and not open_.all():
                    yield state.filter(pa.array(~open_))
                state, wanted = state.filter(pa.array(open_)), np.repeat(open_, counts)
                y, x, counts = y[wanted], x[wanted], counts[open_]
                if not state.num_rows or step == steps:
                    break
                starts = np.cumsum(counts) - counts
                tried = np.stack([state.column(1 + i).to_numpy() for i in range(size)], axis=1)
                eta = (np.repeat(tried, counts, axis=0) * x).sum(axis=1)
                p = 1 / (1 + np.exp(-np.clip(eta, -700.0, None)))
                loss = np.log1p(np.exp(-np.abs(eta))) + np.maximum(eta, 0.0) - y * eta
                miss, weight = (p - y)[:, None] * x, (p * (1 - p))[:, None] * x
                sums = {"loss": loss} | {f"g{i}": miss[:, i] for i in range(size)}
                sums |= {f"h{i}_{j}": weight[:, i] * x[:, j] for i in range(size) for j in range(i + 1)}
                added = [pa.array(np.add.reduceat(v, starts)) for v in sums.values()]
                state = next(run(iter([pa.RecordBatch.from_arrays([*state.columns, *added], [*state.schema.names, *sums])])))
                open_ = ~state.column(size * 3 + 2).to_numpy(zero_copy_only=False)
            if state.num_rows:
                yield state  # took all steps

    return packed.mapInArrow(solve, schema)


def fit_logistic(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, penalty: float = 1.0, steps: int = STEPS) -> DataFrame:
    """One row per group with both labels: ``by`` and ``coefficients``, the intercept first.

    Minimises the summed log loss plus half the squared coefficients times ``penalty``; the intercept is free. Null
    and non-finite features count as zero, rows without a label are left out. Rows are written once. Groups of up to
    ``SMALL_ROWS`` rows are then shuffled once and fitted where they meet; for larger ones a step shuffles
    sums only while their table is small enough to broadcast, and salts hot groups beyond.
    """
    p = len(features) + 1
    names = [f"x{i}" for i in range(1, p)]
    rows = df.filter(F.col(label).isNotNull()).select(
        F.struct(*by).alias("_key"), F.col(label).cast("double").alias("y"), *(finite(F.col(c)).alias(n) for c, n in zip(features, names))
    )
    rows = materialise(rows, "fit-rows")
    columns, run = _steps(p, penalty)
    both = rows.groupBy("_key").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    state = both.select("_key", *(F.lit(0.0).alias(c) for c in columns), F.lit(float("inf")).alias("lowest"), F.lit(False).alias("done"))
    schema = state.schema
    large = both.filter(F.col("n") > SMALL_ROWS).select("_key")
    finished = None
    if small_enough(large):
        large = F.broadcast(large)
        finished = materialise(_fit_small(rows.join(large, "_key", "left_anti"), names, columns, run, schema, steps), "fitted-small")
        rows, state = rows.join(large, "_key", "left_semi"), state.join(large, "_key", "left_semi")
    state = materialise(state, "fit-state")
    x = [F.lit(1.0), *map(F.col, names)]
    tried = [f"t{i}" for i in range(p)]
    finished = state.filter("done") if finished is None else finished.unionAll(state.filter("done"))
    for _ in range(0 if state.isEmpty() else steps):
        open_ = state.select("_key", *tried)
        joined = join_to_unique(rows, open_, "_key", ["_key", "y", *names], "inner")
        eta = sum((F.col(t) * v for t, v in zip(tried, x)), F.lit(0.0))
        rate = joined.withColumn("eta", eta).withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
        weight, miss = F.col("p") * (1 - F.col("p")), F.col("p") - F.col("y")
        loss = F.log1p(F.exp(-F.abs("eta"))) + F.greatest("eta", F.lit(0.0)) - F.col("y") * F.col("eta")
        sums = rate.groupBy("_key").agg(
            F.sum(loss).alias("loss"), *(F.sum(miss * x[i]).alias(f"g{i}") for i in range(p)),
            *(F.sum(weight * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i + 1)),
        )
        state = materialise(join_to_unique(state, sums, "_key", ["_key"], "inner").mapInArrow(run, schema), "fit-state")
        finished = finished.unionAll(state.filter("done"))
        state = state.filter("NOT done")
        if state.isEmpty():
            break
    fitted = finished.unionAll(state)  # a group that took all steps keeps its best
    return fitted.select("_key.*", F.array(*(F.col(f"b{i}") for i in range(p))).alias("coefficients"))


def predict_logistic(df: DataFrame, fitted: DataFrame, by: Sequence[str], features: Sequence[str], row_id: Sequence[str], out: str = "pred") -> DataFrame:
    """Add each row's predicted label by its own group's coefficients; null in a group without a fit."""
    keyed = df.withColumn("_key", F.struct(*by))
    table = fitted.select(F.struct(*by).alias("_key"), "coefficients")
    joined = join_to_unique(keyed, table, "_key", row_id, "left")
    eta = sum((F.get("coefficients", F.lit(i)) * finite(F.col(c)) for i, c in enumerate(features, 1)), F.get("coefficients", F.lit(0)))
    return joined.withColumn(out, (eta > 0).cast("int")).drop("_key", "coefficients")


def fitted_gaps(
    df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, group: str, first, second, row_id: Sequence[str]
) -> DataFrame:
    """The bias score of many datasets, each judged by a linear classifier of its own.

    One row per dataset: ``by``, ``n``, ``demographic_parity``, ``equal_opportunity``, ``bias_score`` and
    ``coefficients``. A dataset whose rows all have one label has no classifier, null coefficients and zero gaps.
    """
    fitted = materialise(fit_logistic(df, by, features, label), "fitted")
    predicted = materialise(predict_logistic(df, fitted, by, features, row_id).select(*by, label, group, "pred"), "predictions")
    keyed = predicted.withColumn("_key", F.struct(*by))  # a struct also matches null keys
    gaps = fairness.prediction_gaps(keyed, label, "pred", group, first, second, by=["_key"])
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    table = fitted.select(F.struct(*by).alias("_key"), "coefficients")
    # one row per dataset on all three sides
    found = sizes.join(gaps, "_key").join(table, "_key", "left")
    zero = {c: F.when(F.col("coefficients").isNull(), 0.0).otherwise(F.col(c)) for c in ("demographic_parity", "equal_opportunity", "bias_score")}
    return found.withColumns(zero).select("_key.*", "n", *zero, "coefficients")

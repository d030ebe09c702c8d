"""Label codes, imputation, one-hot columns and the full mapped encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import moments, profile
from plumbline.operators.skew import HOT_ROWS, small_enough
from plumbline.session import materialise

MISSING = "missing"


def finite(c: Column) -> Column:
    """NaN and both infinities become zero; so does null."""
    x = c.cast("double")
    bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(x.isNull() | bad, 0.0).otherwise(x)


def value_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values numbered from zero in string order.

    Values are range-sorted, and each gets its place in its partition plus the size of the partitions before it.
    """
    values = df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    placed = materialise(
        values.orderBy("value").withColumn("_id", F.monotonically_increasing_id()), "value-codes"
    ).withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return placed.join(F.broadcast(offsets), "_part").select("value", (F.col("_before") + within).alias("code"))


def label_encode(df: DataFrame, column: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the sorted-string code of ``column``.

    A code table of checked size is broadcast. Otherwise the codes of frequent values are
    (rows / bound of them at most), and only the rows of rare values are shuffled.
    """
    codes = value_codes(df, column).withColumnsRenamed({"value": "_value", "code": out})
    key = F.col(column).cast("string")
    matches = key == F.col("_value")
    if small_enough(codes):
        return df.join(F.broadcast(codes), matches, "left").drop("_value")
    counts = df.groupBy(key.alias("_value")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    frequent = codes.join(F.broadcast(counts.select("_value")), "_value", "left_semi")
    marked = df.join(F.broadcast(frequent), matches, "left").drop("_value")
    # null cells have no code, and would all meet in one task
    empty = marked.filter(F.col(out).isNull() & key.isNull())
    rare = marked.filter(F.col(out).isNull() & key.isNotNull()).drop(out).join(codes, matches, "left").drop("_value")
    return marked.filter(F.col(out).isNotNull()).unionByName(rare).unionByName(empty)


def binarise_by_median(df: DataFrame, column: str, out: str) -> DataFrame:
    """1 where a row's value code lies above the median code, for targets with many values."""
    coded = label_encode(df, column, "_code")
    middle = moments.medians(coded, ["_code"])["_code"]
    return coded.withColumn(out, (F.col("_code") > middle).cast("int")).drop("_code")


def one_hot(column: str, values: Sequence[str], drop_first: bool = False) -> list[Column]:
    """One 0/1 column per value, named ``column__value``; missing is a value of its own."""
    cell = F.coalesce(text.clean(F.col(f"`{column}`")), F.lit(MISSING))
    kept = sorted(values)[1:] if drop_first else sorted(values)
    return [F.when(cell == v, 1.0).otherwise(0.0).alias(f"{column}__{v}") for v in kept]


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact median, or zero where a column has no value at all."""
    middle = moments.medians(df, columns)
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(float(middle[c] or 0.0))) for c in columns}
    )


def encode_table(
    df: DataFrame, roles: Mapping[str, str], keep: Sequence[str] = (), dense_levels: int = 1000
) -> tuple[DataFrame, dict]:
    """Numeric matrix of a mapped table as one lazy select, plus what was encoded how.

    Two small metadata jobs come first: levels of the non-numeric columns, and medians.
    Features with more than ``dense_levels`` levels, listed under ``wide``, have no columns of their own: the
    array ``sparse`` names the one-hot feature that is 1 in each of them. So no level of any feature is left out.
    """
    profiled = profile.profile(df.select(*[F.col(f"`{c}`") for c in roles])).persist()  # a row per column
    problems = profile.check_roles(roles, profiled)
    facts = {r["column"]: r for r in profiled.collect()}
    profiled.unpersist()
    if problems:
        raise ValueError("; ".join(problems))
    target = next(c for c, r in roles.items() if r == "target")
    protected = next((c for c, r in roles.items() if r == "protected_attribute"), None)
    features = [c for c, r in roles.items() if r == "feature"]
    fields = {f.name: f for f in df.schema.fields}
    numeric = [c for c in features if profile.is_numeric(fields[c])]
    others = [c for c in features if c not in numeric]
    wide = [c for c in others if facts[c]["n_distinct"] > dense_levels]
    coded = [c for c in [protected, *others, target] if c and c not in wide]
    found: dict[str, list[str]] = {c: [] for c in coded}
    for row in profile.levels(df, coded).select("column", "value").collect():  # at most dense_levels per feature
        found[row["column"]].append(row["value"])
    for c in coded:
        has_gaps = facts[c]["n_present"] < facts[c]["n_rows"]
        found[c] = sorted({*found[c], MISSING} if has_gaps else found[c])
    middle = moments.medians(df, numeric)

    def code(c: str) -> Column:
        cell = F.coalesce(text.clean(F.col(f"`{c}`")), F.lit(MISSING))
        return (F.array_position(F.lit(found[c]), cell) - 1).cast("double")

    columns: list[Column] = []
    names: list[str] = []
    for c in ([protected] if protected else []) + features:
        if c in wide:
            continue
        if c in numeric:
            filled = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(middle[c] or 0.0)))
            columns.append(finite(filled).alias(c))
            names.append(c)
        elif c == protected or len(found[c]) <= 2:
            columns.append(code(c).alias(c))
            names.append(c)
        else:
            columns += one_hot(c, found[c])
            names += [f"{c}__{v}" for v in found[c]]
    if wide:
        hot = [F.concat(F.lit(f"{c}__"), F.coalesce(text.clean(F.col(f"`{c}`")), F.lit(MISSING))) for c in wide]
        columns.append(F.array(*hot).alias("sparse"))
    encoded = df.select(*keep, *columns, code(target).alias("label"))
    return encoded, {
        "features": names,
        "protected": protected,
        "target": target,
        "target_classes": found[target],
        "protected_classes": found.get(protected),
        "wide": wide,
    }


def long_features(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Sparse one-hot in long form, (row, feature, 1.0): no limit on distinct values."""
    cells = df.select(row_id, *[F.coalesce(text.clean(F.col(c)), F.lit(MISSING)).alias(c) for c in columns])
    long = cells.unpivot([row_id], list(columns), "column", "value")
    return long.select(row_id, F.concat_ws("__", "column", "value").alias("feature"), F.lit(1.0).alias("x"))

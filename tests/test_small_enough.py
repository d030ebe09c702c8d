"""What may be broadcast is measured whole, whatever the type of its columns."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.skew import small_enough


def text():
    return F.repeat(F.lit("x"), 1000)


WIDE = {
    "string": lambda: text(),
    "binary": lambda: text().cast("binary"),
    "array": lambda: F.sequence(F.lit(1), F.lit(1000)),
    "array of binaries": lambda: F.array_repeat(text().cast("binary"), 2),
    "array of structs": lambda: F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.struct(i.alias("line"), i.alias("name"))),
    "map": lambda: F.create_map(F.lit("k"), text()),
    "struct": lambda: F.struct(text().cast("binary").alias("a")),
}


@pytest.mark.parametrize("kind", WIDE)
def test_wide_columns_are_measured(spark, kind):
    df = spark.range(20).select("id", WIDE[kind]().alias("a.b"))
    assert not small_enough(df, 100, 10_000)
    assert small_enough(df, 100, 10_000_000) and not small_enough(df, 10, 10_000_000)


def test_nulls_are_small(spark):
    df = spark.range(5).select(*(F.lit(None).cast(t).alias(f"c{i}") for i, t in enumerate(["binary", "array<int>", "array<string>", "map<string,int>", "struct<a:binary>"])))
    assert small_enough(df, 5, 10_000)

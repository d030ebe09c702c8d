"""Joins and windows that stay bounded when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import materialise

# Bounds the rows of one key that reach one task, and (rows / bound) the hot keys.
HOT_ROWS = 1_000_000
NULL_SALTS = 1 << 20
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A filter of keys: bits per key, bits that a key sets in its block of 64, and the most blocks.
FILTER_BITS = 16
FILTER_PROBES = 4
FILTER_BLOCKS = 1 << 19


def _width(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes: texts, binaries and all that arrays, maps and structs hold count whole."""
    if isinstance(kind, (T.StringType, T.BinaryType, T.CharType, T.VarcharType)):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.NumericType, T.BooleanType, T.DatetimeType)):
            return 16 + 16 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
        total = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _width(x, inner))
        return 16 + F.coalesce(total, F.lit(0).cast("long"))
    if isinstance(kind, T.MapType):
        sides = ((F.map_keys(c), kind.keyType), (F.map_values(c), kind.valueType))
        return sum((_width(x, T.ArrayType(t)) for x, t in sides), F.lit(0).cast("long"))
    if isinstance(kind, T.StructType):
        return sum((_width(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(16).cast("long")


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, bytes_: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast: counted, and its values measured where they stand."""
    width = sum((_width(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    size = df.select(width.alias("w")).limit(rows + 1).agg(F.count("w").alias("n"), F.sum("w").alias("b")).first()
    return size["n"] <= rows and (size["b"] or 0) <= bytes_


def join_to_unique(
    left: DataFrame,
    right: DataFrame,
    key: str,
    row_id: Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join many rows to a table with one row per key.

    A right side of checked size is broadcast. Otherwise keys with more than ``hot_rows``
    rows on the left are spread over several salts, and only their right rows are copied.
    The salt is a hash of the row's identity, so a re-run task salts as before.
    """
    if small_enough(right, broadcast_rows):
        return left.join(F.broadcast(right), key, how)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = F.broadcast(counts.select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    spread = F.coalesce(F.col("_salts"), F.lit(1))
    # a null key meets no right row, so any salt will do: all of them part these rows
    salts = F.when(F.col(key).isNull(), NULL_SALTS).otherwise(spread)
    salted = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*row_id), salts).cast("int"))
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), spread - 1)))
    return salted.drop("_salts").join(copied.drop("_salts"), [key, "_salt"], how).drop("_salt")


def may_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` that an inner join by ``key`` may keep: nearly all others go before they are shuffled.

    A blocked Bloom filter of the right keys, one 64-bit block per key, of bounded size and broadcast. Rows it lets
    through by mistake meet nothing in the join.
    """
    blocks = max(1, min(FILTER_BLOCKS, right.count() * FILTER_BITS // 64))
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block")
    drawn = F.xxhash64(key, F.lit("bits"))
    places = [F.shiftrightunsigned(drawn, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(FILTER_PROBES)]
    mask = reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places])
    bloom = F.broadcast(right.filter(F.col(key).isNotNull()).groupBy(block).agg(F.bit_or(mask).alias("_bits")))
    met = left.withColumn("_block", block).join(bloom, "_block")
    return met.filter(F.col("_bits").bitwiseAND(mask) == mask).select(left.columns)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a broadcast side of few rows by ``keys``, where null meets null."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    matches = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(F.broadcast(right.withColumnsRenamed(names)), matches, how).drop(*names.values())


def with_time_bucket(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], rows: int = HOT_ROWS, out: str = "_bucket"
) -> tuple[DataFrame, bool]:
    """Cut the history of hot keys into pieces of ``rows`` rows each, numbered from one in order.

    Rows of hot keys are range-sorted by key and the whole order, so that rows of one instant
    are parted too, and written once; a row's place is its place in its partition plus the rows
    of its key in partitions before. Keys up to the bound stay in piece zero. Hot keys number
    at most total / rows, and their runs as many more as there are partitions: both are
    broadcast. Returns the table and whether any key was cut.
    """
    order = [order] if isinstance(order, str) else list(order)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    if hot.isEmpty():
        return df.withColumn(out, F.lit(0)), False
    marked = join_null_safe(df, hot, keys)
    cold = marked.filter("_n IS NULL").drop("_n").withColumn(out, F.lit(0))
    sorted_rows = marked.filter("_n IS NOT NULL").drop("_n").orderBy(*keys, *order)
    placed = materialise(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    piece = F.expr(f"CAST((_before + _id - _first) DIV {int(rows)} + 1 AS INT)")
    numbered = join_null_safe(placed, runs, [*keys, "_part"], "inner").withColumn(out, piece)
    return cold.unionByName(numbered.drop("_part", "_id", "_first", "_before")), True


def with_preceding(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    n: int,
    rows: int = HOT_ROWS,
    agg: Callable[[str], Column] = F.avg,
    out: str = "preceding",
) -> DataFrame:
    """Add an aggregate (mean by default) of the ``n`` values before each row of its key.

    Where keys were cut into pieces, each piece starts with the last ``n`` rows of
    the pieces before it, so the result equals one window over the whole key.
    """
    cut, any_cut = with_time_bucket(df, keys, order, rows)
    spec = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = agg(value).over(spec.rowsBetween(-n, -1))
    if not any_cut:
        return cut.withColumn(out, before).drop("_bucket")
    entry = F.struct(*order, value)
    latest = Window.partitionBy(*keys, "_bucket").orderBy(*[F.col(c).desc() for c in order])
    tails = (
        cut.withColumn("_r", F.row_number().over(latest))
        .filter(F.col("_r") <= n)
        .groupBy(*keys, "_bucket")
        .agg(F.sort_array(F.collect_list(entry)).alias("tail"))
    )
    # every bucket here holds a row, so n buckets back are enough to find n rows
    back = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(-n, -1)
    carried = tails.withColumn("carry", F.flatten(F.collect_list("tail").over(back)))
    last_n = F.expr(f"slice(carry, greatest(size(carry) - {n - 1}, 1), {n})")
    halo = (
        carried.filter(F.size("carry") > 0)
        .select(*keys, "_bucket", F.inline(last_n))
        .withColumn("_halo", F.lit(True))
    )
    both = cut.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    return both.withColumn(out, before).filter(~F.col("_halo")).drop("_halo", "_bucket")

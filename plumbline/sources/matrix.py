"""JSON matrix payloads: parse, check the shape, explode into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import schemas


def parse(df: DataFrame, column: str) -> DataFrame:
    """Add ``matrix`` and ``problem``. Text that is not JSON at all is text mode, not an error."""
    stripped = F.trim(F.col(column))
    parsed = F.struct(
        stripped.rlike(r"^[\[{]").alias("looks_json"), F.try_parse_json(stripped).isNotNull().alias("valid_json"),
        F.from_json(stripped, schemas.MATRIX).alias("matrix"), (stripped == "").alias("empty"),
    )
    m = F.col("matrix")
    width = F.size(F.element_at(m["features"], 1))
    names_given = m["feature_names"].isNotNull()
    place = F.coalesce(m["protected_index"], F.lit(0))
    ragged = F.exists(m["features"], lambda row: F.size(row) != width)
    gaps = F.exists(m["features"], lambda row: F.exists(row, lambda x: x.isNull()))
    problem = (
        F.when(F.col("empty"), "empty input")
        .when(~F.col("looks_json"), F.lit(None).cast("string"))
        .when(~F.col("valid_json"), "invalid JSON")
        .when(m["features"].isNull() | m["labels"].isNull(), "features and labels are required")
        .when(F.size(m["features"]) == 0, "empty dataset")
        .when(ragged | gaps, "features must be a full numeric 2-D array")
        .when(F.exists(m["labels"], lambda x: x.isNull()), "labels must be numeric")
        .when(F.size(m["features"]) != F.size(m["labels"]), "features and labels differ in length")
        .when(names_given & (F.size(m["feature_names"]) != width), "feature_names do not match the columns")
        .when((place < 0) | (place >= width), "protected_index is out of range")
    )
    # from a generated row, or a filter on the problem would parse the text anew for each part of the check
    return (
        df.select("*", F.inline(F.array(parsed)))
        .withColumn("problem", problem)
        .withColumn("mode", F.when(F.col("looks_json"), "dataset").otherwise("text"))
        .drop("looks_json", "valid_json", "empty")
    )


def rows(parsed: DataFrame, key: str) -> DataFrame:
    """(key, row, features, label, protected) of every valid matrix."""
    valid = parsed.filter("problem IS NULL AND mode = 'dataset'")
    zipped = F.arrays_zip(F.col("matrix.features").alias("x"), F.col("matrix.labels").alias("y"))
    long = valid.select(key, F.col("matrix.protected_index").alias("at"), F.posexplode(zipped).alias("row", "cell"))
    place = F.coalesce("at", F.lit(0))
    return long.select(
        key, "row", F.col("cell.x").alias("features"), F.col("cell.y").alias("label"),
        F.get(F.col("cell.x"), place).alias("protected"),
    )

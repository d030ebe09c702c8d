"""Data-quality scans: formula injection, personal data, label distribution, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import constants as K
from plumbline.functions import text


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def injection_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Formula-like cells per text column, from one pass over the table."""
    cols = list(columns or text_columns(df))
    wide = df.agg(*[F.count_if(text.looks_like_formula(F.col(c))).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "flagged_cells")


def injection_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that hold at least one formula-like cell, with the columns at fault."""
    cols = list(columns or text_columns(df))
    at_fault = F.array_compact(F.array(*[F.when(text.looks_like_formula(F.col(c)), c) for c in cols]))
    return df.withColumn("flagged_columns", at_fault).filter(F.size("flagged_columns") > 0)


def sanitise(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Neutralise formula-like cells in every text column."""
    return df.withColumns({c: text.sanitise(F.col(c)) for c in (columns or text_columns(df))})


def _redaction_steps(df: DataFrame, column: str) -> DataFrame:
    """The text after each redaction step. Steps are columns of their own: nested in one
    expression, every step would run its predecessors again."""
    return (
        df.withColumn("_mail", text.without_mail(F.col(column)))
        .withColumn("_ssn", text.without_ssn(F.col("_mail")))
        .withColumn("_phone", text.without_phone(F.col("_ssn")))
    )


def redact(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Blank out e-mail addresses, social security numbers, then phone numbers."""
    for c in columns or text_columns(df):
        df = _redaction_steps(df, c).withColumn(c, F.col("_phone")).drop("_mail", "_ssn", "_phone")
    return df


def personal_data_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """How often each kind of personal data is blanked; later patterns see earlier blanks."""
    steps = df.select(*by, column).withColumn("_mail", text.without_mail(F.col(column)))
    steps = steps.withColumn("_ssn", text.without_ssn(F.col("_mail")))
    digits = F.col("_mail").rlike(r"\d{4}")
    found = {
        "emails": text.occurrences(F.col(column), K.EMAIL_PATTERN, F.col(column).contains("@")),
        "ssns": text.occurrences(F.col("_mail"), K.SSN_PATTERN, digits),
        "phones": text.occurrences(F.col("_ssn"), K.PHONE_PATTERN, digits),
    }
    return steps.groupBy(*by).agg(*[F.sum(x).alias(n) for n, x in found.items()])


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint: row count, sum and xor of row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    )

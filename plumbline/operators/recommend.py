"""Which audit suits a table: domain signals and an audit profile, one row per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import constants as K

DOMAINS = list(K.DOMAIN_KEYWORDS)


def _pattern(words: list[str]) -> str:
    return "|".join(words)


def protected_columns(columns: DataFrame) -> DataFrame:
    """Mark column names that hint at a protected attribute."""
    return columns.withColumn("protected", F.lower("column").rlike(_pattern(K.PROTECTED_NAME_HINTS)))


def domain_signals(columns: DataFrame) -> DataFrame:
    """Columns per dataset whose name holds a keyword of each domain; one row per dataset."""
    name = F.lower("column")
    return columns.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_columns"),
        *[F.count_if(name.rlike(_pattern(words))).alias(d) for d, words in K.DOMAIN_KEYWORDS.items()],
        F.count_if(name.rlike(_pattern(K.PROTECTED_NAME_HINTS))).alias("n_protected"),
        F.max("n_rows").alias("n_rows"),
    )


def recommend(columns: DataFrame) -> DataFrame:
    """Depth, weights, framework, explainability, priority and detail for each dataset.

    ``columns`` has ``dataset, column, n_rows``. Ties between domains go to the one listed
    first; without any signal the general profile applies.
    """
    found = domain_signals(columns)
    best = F.greatest(*[F.col(d) for d in DOMAINS])
    domain = F.when(best == 0, "general")
    for d in DOMAINS:
        domain = domain.when(F.col(d) == best, d)
    depth = (
        F.when((F.col("n_rows") >= 2000) | (F.col("n_columns") >= 15), "thorough")
        .when((F.col("n_rows") <= 200) & (F.col("n_columns") <= 6), "fast")
        .otherwise("standard")
    )

    def looked_up(i: int):
        out = F.lit(K.DOMAIN_PROFILES["general"][i])
        for d, profile in K.DOMAIN_PROFILES.items():
            out = F.when(F.col("domain") == d, profile[i]).otherwise(out)
        return out

    signal, protected = F.col("domain") != "general", F.col("n_protected") > 0
    return (
        found.withColumn("domain", domain)
        .withColumn("signals", best)
        .withColumn("depth", depth)
        .withColumn("preset", looked_up(0))
        .withColumn("framework", looked_up(1))
        .withColumn("explainability", F.when(protected, "high").otherwise("standard"))
        .withColumn(
            "review_priority",
            F.when(signal & protected, "high").when(signal | protected, "medium").otherwise("standard"),
        )
        .withColumn("report_detail", F.when(signal | protected, "executive").otherwise("standard"))
        .withColumn(
            "profile",
            F.when(signal, F.concat(F.initcap("domain"), F.lit(" Compliance Audit")))
            .when(protected, "Fairness-Focused Audit")
            .otherwise("General Trust Audit"),
        )
        .drop(*DOMAINS)
    )

"""Report documents: an audit, its parsed report and its review trail, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.review import with_latest_review


def report_rows(audits: DataFrame, reviews: DataFrame, report: str = "report_json") -> DataFrame:
    """One JSON document per audit, ready for ``write.text`` or ``write.json``."""
    joined = with_latest_review(audits, reviews)
    document = F.to_json(
        F.struct(
            F.struct("audit_id", "audit_type", "trust", "bias", "truth").alias("audit"),
            F.try_parse_json(F.col(report)).alias("report"),
            F.when(F.col("review_id").isNotNull(), F.struct("review_id", "review_status")).alias("review"),
        )
    )
    return joined.withColumn("document", document)


def write_reports(documents: DataFrame, path: str) -> None:
    """One JSON document per line."""
    documents.select("document").write.mode("errorifexists").text(path)

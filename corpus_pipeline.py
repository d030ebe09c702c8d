"""The corpus pipeline: five stages over ``documents``, each one of the operators in ``plumbline.llm``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, lines, mixing, near, quality
from plumbline.llm.common import join_checked, table
from plumbline.session import materialise, scratch_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
READ = ("doc_id", "text", "source", "n_chars")  # the columns that stages read or write


def _set_aside(stage: Stage) -> Stage:
    """A filtering stage under which no further column of ``docs`` can clash with the operators' own names."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in READ else f"further{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run_stage


@_set_aside
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject.

    Null and empty texts are scored as texts without words, long ones whole; repeated rows are judged alike. Further
    columns of ``docs`` stay as they are. An empty table stays empty.
    """
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(docs.columns)


@_set_aside
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat or resemble an earlier line; ``n_chars`` counts what is left.

    Every document stays, a text may become empty; a null text stays null. Of repeated rows, the later ones lose
    their lines. Further columns stay as they are.
    """
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_set_aside
def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, null last; of several, any one.

    Texts without words, null and empty ones among them, resemble none; one of fewer than five words resembles its
    equals. Further columns stay as they are.
    """
    # rows are told apart by a written number, since doc_id may be null or repeated
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    classes = near.near_duplicates(rows.select("_row", "text"), key="_row")
    members = materialise(classes.filter("class_size > 1").select("_row", "class_id"), "class-members")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = members.join(rows.select("_row", "doc_id"), "_row").groupBy("class_id").agg(F.min(order).alias("first"))
    gone = members.join(first.select(F.col("first._row").alias("_row")), "_row", "left_anti").select("_row")
    return join_checked(rows, materialise(gone, "class-losers"), "_row", "left_anti").select(docs.columns)


@_set_aside
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged alike. Further columns stay as they are.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: one row per row, repeated ones too.

    Null and empty texts have size 0, a null source is a source of its own, further columns are left away.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", keep_one_of_group),
    ("benchmark", drop_benchmark),
    ("mix", mix),
]

# A classifier, a similarity join and a minimum hash are beyond SQL; the operators are tested against brute force,
# the stage of near duplicates and the run on odd rows in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written as Parquet below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

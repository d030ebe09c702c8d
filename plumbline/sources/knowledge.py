"""Knowledge-base ingest: header aliases, minimum length, one article per title."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import text as TX


def normalise(df: DataFrame, order: str | None = None) -> DataFrame:
    """Columns ``title, content, source`` from whatever the headers say.

    ``order`` numbers untitled articles; it must be a unique column of the input.
    """
    lowered = df.toDF(*[c.strip().lower() for c in df.columns])
    if "content" not in lowered.columns:
        alias = next((c for c in lowered.columns if c in K.CONTENT_ALIASES), None)
        if alias is None:
            raise ValueError("the table needs a content column")
        lowered = lowered.withColumnRenamed(alias, "content")
    if "title" not in lowered.columns:
        number = F.col(order.lower()) + 1 if order else F.monotonically_increasing_id() + 1
        lowered = lowered.withColumn("title", F.concat(F.lit("Article "), number.cast("string")))
    if "source" not in lowered.columns:
        lowered = lowered.withColumn("source", F.lit("csv-upload"))
    return lowered


def new_articles(
    batch: DataFrame, existing: DataFrame, order: str,
    content_chars: int | None = None, source_chars: int | None = None,
) -> DataFrame:
    """Articles to append: long enough, with a title not stored yet, first of their title.

    Whole texts are kept unless a stored length is asked for.
    """
    usable = batch.filter(F.length(TX.strip(F.col("content"))) >= K.MIN_ARTICLE_CHARS)
    # each map task keeps one row per title before the shuffle, however common the title
    first = Window.partitionBy("title").orderBy(order)
    firsts = usable.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    fresh = firsts.join(existing.select("title"), "title", "left_anti")
    if content_chars:
        fresh = fresh.withColumn("content", F.substring("content", 1, content_chars))
    if source_chars:
        fresh = fresh.withColumn("source", F.substring("source", 1, source_chars))
    return fresh


def stats(kb: DataFrame, key: str, newest: int = 5) -> DataFrame:
    """The newest articles, each beside the total."""
    total = kb.count()
    return kb.orderBy(F.col(key).desc()).limit(newest).select(key, "title", "source", F.lit(total).alias("total_articles"))

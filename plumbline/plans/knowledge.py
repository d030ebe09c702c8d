"""Knowledge-base jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.plans.inputs import ARTICLES, articles, sql_strip
from plumbline.plans.registry import job
from plumbline.sources import knowledge
from plumbline.sources.tables import load

# Documents that carry a label are in the store already; the others come twice in the upload.
INGEST = f"""fresh AS (
  SELECT doc_id, coalesce(source, '') || '/' || doc_id AS title, text AS content, source FROM documents
  WHERE length({sql_strip('text')}) >= {K.MIN_ARTICLE_CHARS} AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))"""


def _upload(spark, d):
    """Documents under titles that name them, each twice, and the titles stored before."""
    title = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    docs = load(spark, d, "documents").select("doc_id", title.alias(" Title"), F.col("text").alias("Body"), "source")
    sent = F.explode(F.array(F.lit(1), F.lit(2))).alias("sent")
    stored = docs.join(load(spark, d, "labels"), "doc_id", "left_semi").select(F.col(" Title").alias("title"))
    return knowledge.normalise(docs.select("*", sent)), stored


@job("kb_ingest", "S7 S8 J8", f"""WITH {INGEST}
SELECT doc_id, title, content, source, 1 AS sent FROM fresh""")
def kb_ingest(spark, d):
    """Documents into the knowledge base, whole texts, the first of each title not stored yet."""
    batch, stored = _upload(spark, d)
    return knowledge.new_articles(batch, stored, "sent").select("doc_id", "title", "content", "source", "sent")


@job("kb_ingest_stored_length", "S7", f"""WITH {INGEST}
SELECT doc_id, title, left(content, {K.ARTICLE_CHARS}) AS content, left(source, {K.SOURCE_CHARS}) AS source FROM fresh""")
def kb_ingest_stored_length(spark, d):
    """The same with the column widths of the article store."""
    batch, stored = _upload(spark, d)
    kept = knowledge.new_articles(batch, stored, "sent", K.ARTICLE_CHARS, K.SOURCE_CHARS)
    return kept.select("doc_id", "title", "content", "source")


@job("kb_default_titles", "S7", """SELECT doc_id, 'Article ' || (doc_id + 1) AS title, 'csv-upload' AS source FROM documents""")
def kb_default_titles(spark, d):
    batch = load(spark, d, "documents").select("doc_id", "text")
    return knowledge.normalise(batch, order="doc_id").select("doc_id", "title", "source")


@job("kb_stats", "S15", f"""WITH {ARTICLES}
SELECT kb_id, title, source, (SELECT count(*) FROM articles) AS total_articles FROM articles ORDER BY kb_id DESC LIMIT 5""")
def kb_stats(spark, d):
    return knowledge.stats(articles(spark, d), "kb_id")

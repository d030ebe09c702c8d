"""How the given tables stand in for audit inputs, in Spark and as SQL fragments.

decisions   orders with their customer: label, a rule-based prediction, segment, nation
audits      one stored audit per event, scores from the event's value and props
reviews     one queue entry per event other than a view, pointing at an earlier audit
feedback    one entry per event
articles    the benchmark passages as a knowledge base
outputs     assistant turns, with the user turn before them as prompt
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import scores
from plumbline.operators.skew import join_to_unique
from plumbline.sources.tables import load


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """One customer may hold many of the orders, hence the skew-safe join."""
    orders = load(spark, d, "orders").withColumnRenamed("o_custkey", "custkey")
    customer = load(spark, d, "customer").select(
        F.col("c_custkey").alias("custkey"), "c_nationkey", "c_mktsegment", "c_acctbal"
    )
    return join_to_unique(orders, customer, "custkey", ["o_orderkey"], how="inner").select(
        F.col("o_orderkey").alias("row_id"),
        "custkey",
        F.col("c_nationkey").alias("dataset"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("balance"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("pred"),
    )


DECISIONS = """decisions AS (
  SELECT o_orderkey AS row_id, o_custkey AS custkey, c_nationkey AS dataset, c_mktsegment AS segment,
         o_orderpriority AS priority, o_totalprice AS price, c_acctbal AS balance,
         CAST(o_orderstatus = 'F' AS INT) AS label,
         CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS pred
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def audits(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    scored = F.col("event_type") != "error"
    return (
        events.select(
            F.col("event_id").alias("audit_id"),
            F.col("user_id").alias("tenant"),
            F.col("ts").alias("created_at"),
            "event_type",
            F.when(F.col("event_type") == "purchase", "llm")
            .when(F.col("event_type") == "signup", "text")
            .otherwise("dataset")
            .alias("audit_type"),
            F.col("props").alias("report_json"),
            k.alias("k"),
            F.col("value"),
            F.when(scored, k / 200.0).alias("bias"),
            F.when(scored, F.least(F.col("value") / 100.0, F.lit(1.0))).alias("truth"),
        )
        .withColumn("trust", scores.trust_score(F.col("truth"), F.col("bias"), F.lit(K.DEFAULT_CONFIDENCE)))
    )


AUDITS = """audits AS (
  SELECT *, greatest(0.0, least(1.0, 0.4 * truth + (1 - bias) * 0.4 + 0.85 * 0.2)) * CASE WHEN truth IS NULL THEN NULL ELSE 1 END AS trust
  FROM (SELECT event_id AS audit_id, user_id AS tenant, ts AS created_at, event_type,
               CASE event_type WHEN 'purchase' THEN 'llm' WHEN 'signup' THEN 'text' ELSE 'dataset' END AS audit_type,
               props AS report_json, CAST(props->>'$.k' AS INT) AS k, value,
               CASE WHEN event_type <> 'error' THEN CAST(props->>'$.k' AS INT) / CAST(200 AS DOUBLE) END AS bias,
               CASE WHEN event_type <> 'error' THEN least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) END AS truth
        FROM events))"""

STATUS_OF = {"click": "pending", "purchase": "approved", "error": "rejected", "signup": "escalated"}


def reviews(spark: SparkSession, d: str) -> DataFrame:
    a = audits(spark, d).filter(F.col("event_type") != "view")
    status = F.col("event_type")
    for event, name in STATUS_OF.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    return a.select(
        F.col("audit_id").alias("review_id"),
        (F.col("audit_id") - F.col("k")).alias("audit_id"),
        "tenant",
        status.alias("status"),
        F.when(F.col("k") < 10, "").otherwise("seen").alias("notes"),
        "created_at",
    )


REVIEWS = """reviews AS (
  SELECT audit_id AS review_id, audit_id - k AS audit_id, tenant,
         CASE event_type WHEN 'click' THEN 'pending' WHEN 'purchase' THEN 'approved'
                         WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'escalated' END AS status,
         CASE WHEN k < 10 THEN '' ELSE 'seen' END AS notes, created_at
  FROM audits WHERE event_type <> 'view')"""


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return audits(spark, d).select(
        F.col("audit_id").alias("feedback_id"),
        (F.col("audit_id") - F.col("k")).alias("audit_id"),
        (F.col("value") >= 20).alias("correct"),
        (F.col("k") < 35).alias("bias_flag"),
        F.col("created_at").alias("ts"),
    )


FEEDBACK = """feedback AS (
  SELECT audit_id AS feedback_id, audit_id - k AS audit_id, value >= 20 AS correct, k < 35 AS bias_flag, created_at AS ts
  FROM audits)"""


def articles(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select(
        F.col("item_id").alias("kb_id"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"),
        F.col("text").alias("content"),
        F.lit("benchmark").alias("source"),
    )


ARTICLES = """articles AS (
  SELECT item_id AS kb_id, 'item ' || item_id AS title, text AS content, 'benchmark' AS source FROM benchmark)"""


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """A prompt is the turn before: an equi-join on the turn number, no ordered window."""
    turns = load(spark, d, "conversations")
    before = turns.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")
    )
    return (
        turns.filter("role = 'assistant'")
        .select("conv_id", "turn", F.col("text").alias("output"))
        .join(before, ["conv_id", "turn"], "left")
    )


OUTPUTS = """outputs AS (
  SELECT a.conv_id, a.turn, a.text AS output, p.text AS prompt
  FROM conversations a LEFT JOIN conversations p
    ON p.conv_id = a.conv_id AND p.turn = a.turn - 1 AND p.role = 'user'
  WHERE a.role = 'assistant')"""

# Spelled as in the patterns of plumbline.functions.text, for RE2.
SQL_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
SQL_WORD = r"[\p{L}\p{N}_]{2,}"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_claims(c: str) -> str:
    """List of claims of a text column."""
    pieces = f"string_split_regex({c}, '[.!?]{SQL_WS}+')"
    return f"list_filter(list_transform({pieces}, lambda p: {sql_strip('p')}), lambda p: p <> '')"


SQL_STOP = "[" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + "]"


def sql_words(c: str) -> str:
    found = f"regexp_extract_all(lower({c}), '{SQL_WORD}')"
    return f"list_filter({found}, lambda w: NOT list_contains({SQL_STOP}, w))"


def sql_index(kb: str = "articles", kb_id: str = "kb_id", content: str = "content", terms: int | None = None) -> str:
    """CTEs kb_terms, vocabulary, kb_weights: the tf-idf index of a knowledge base."""
    limit = "" if terms is None else f"ORDER BY cf DESC, term LIMIT {terms}"
    return f"""kb_words AS (SELECT {kb_id} AS kb_id, {sql_words(content)} AS ws FROM {kb}),
kb_terms AS (
  SELECT kb_id, term, count(*) AS tf FROM (
    SELECT kb_id, unnest(ws) AS term FROM kb_words
    UNION ALL
    SELECT kb_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM kb_words)
  GROUP BY ALL),
n_docs AS (SELECT count(*) AS n FROM {kb}),
vocabulary AS (
  SELECT term, df, cf, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM (
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM kb_terms GROUP BY term {limit}), n_docs),
kb_weights AS (
  SELECT kb_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY kb_id)) AS w
  FROM (SELECT kb_id, term, tf * idf AS w FROM kb_terms JOIN vocabulary USING (term)))"""


def sql_support(texts: str, keys: str, column: str, k: int = K.TOP_K, threshold: float = K.SPARSE_TRUTH_AT) -> str:
    """CTEs hits and support for a CTE of texts, over the index CTEs.

    Texts are tied to the first k passages at zero similarity, as an exact index does.
    """
    return f"""text_words AS (SELECT {keys}, {sql_words(column)} AS ws FROM {texts}),
text_terms AS (
  SELECT {keys}, term, count(*) AS tf FROM (
    SELECT {keys}, unnest(ws) AS term FROM text_words
    UNION ALL
    SELECT {keys}, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM text_words)
  GROUP BY ALL),
text_weights AS (
  SELECT {keys}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS w
  FROM (SELECT {keys}, term, tf * idf AS w FROM text_terms JOIN vocabulary USING (term))),
sims AS (
  SELECT {keys}, kb_id, sum(s) AS sim FROM (
    SELECT {', '.join('q.' + c.strip() for c in keys.split(','))}, d.kb_id, q.w * d.w AS s
    FROM text_weights q JOIN kb_weights d USING (term)
    UNION ALL
    SELECT {keys}, f.kb_id, 0.0 FROM {texts}, (SELECT kb_id FROM kb_words ORDER BY kb_id LIMIT {k}) f)
  GROUP BY ALL),
hits AS (
  SELECT * FROM (
    SELECT {keys}, kb_id, sim, row_number() OVER (PARTITION BY {keys} ORDER BY round(sim, 9) DESC, kb_id) AS rank FROM sims)
  WHERE rank <= {k}),
support AS (
  SELECT {keys}, sum(sim) / least({k}, max(n)) AS groundedness,
         least(sum(sim) / least({k}, max(n)) / {threshold}, 1.0) AS truth
  FROM hits, n_docs GROUP BY {keys})"""

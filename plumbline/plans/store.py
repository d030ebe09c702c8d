"""Audit-store jobs: latest rows, append-only guard, retention, compaction, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import text as TX
from plumbline.operators import store
from plumbline.plans.inputs import AUDITS, OUTPUTS, REVIEWS, audits, outputs, reviews
from plumbline.plans.registry import job, rounded
from plumbline.session import scratch_path
from plumbline.sources import reports


@job("latest_audit_per_tenant", "S9 W3", f"""WITH {AUDITS}
SELECT tenant, audit_id, created_at FROM audits
QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY created_at DESC, audit_id DESC) = 1""")
def latest_audit_per_tenant(spark, d):
    """A re-used id would replace: the newest row per key wins."""
    return store.latest(audits(spark, d), ["tenant"], ["created_at", "audit_id"]).select("tenant", "audit_id", "created_at")


@job("audit_append", "S9 S10 C26", f"""WITH {OUTPUTS}
SELECT conv_id || '-' || turn AS id, output AS input, prompt FROM outputs""")
def audit_append(spark, d):
    """Two batches appended to an audit table; the second repeats the first and is rejected."""
    batch = outputs(spark, d).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("output").alias("input"), F.col("output").alias("corrected"), "prompt"
    )
    path = scratch_path(spark, "audits")
    store.append_audits(path, batch)
    accepted, _ = store.split_updates(batch, spark.read.parquet(path), "id")
    store.append_audits(path, accepted)
    return spark.read.parquet(path).select("id", "input", "prompt")


@job("append_only_guard", "S10", f"""WITH {AUDITS}, incoming AS (SELECT audit_id + 40 * k AS audit_id, k FROM audits)
SELECT audit_id, k, audit_id IN (SELECT audit_id FROM audits) AS rejected FROM incoming""")
def append_only_guard(spark, d):
    stored = audits(spark, d)
    incoming = stored.select((F.col("audit_id") + 40 * F.col("k")).alias("audit_id"), "k")
    fresh, updates = store.split_updates(incoming, stored, "audit_id")
    return fresh.withColumn("rejected", F.lit(False)).unionByName(updates.withColumn("rejected", F.lit(True)))


@job("retained_per_tenant", "S11", f"""WITH {AUDITS}
SELECT tenant, audit_id FROM audits QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY created_at DESC, audit_id DESC) <= {K.KEEP_AUDITS}""")
def retained_per_tenant(spark, d):
    return store.newest(audits(spark, d), ["created_at", "audit_id"], K.KEEP_AUDITS, by=["tenant"]).select("tenant", "audit_id")


@job("pruned_reviews", "S11 J6", f"""WITH {AUDITS}, {REVIEWS}
SELECT review_id, status FROM reviews WHERE review_id NOT IN (SELECT review_id FROM reviews ORDER BY review_id DESC LIMIT {K.KEEP_REVIEWS})""")
def pruned_reviews(spark, d):
    return store.pruned(reviews(spark, d), "review_id", ["review_id"], K.KEEP_REVIEWS).select("review_id", "status")


@job("newest_audits", "T1 T3", f"""WITH {AUDITS}
SELECT audit_id, round(trust, 9) AS trust, round(bias, 9) AS bias, round(truth, 9) AS truth, created_at
FROM audits ORDER BY created_at DESC, audit_id DESC LIMIT 30""")
def newest_audits(spark, d):
    newest = store.newest(audits(spark, d), ["created_at", "audit_id"], 30)
    return rounded(newest.select("audit_id", "trust", "bias", "truth", "created_at"))


@job("recent_dashboard", "T2", f"""WITH {AUDITS}
SELECT audit_id, left(report_json, 100) AS preview, audit_type, round(trust, 9) AS trust, coalesce(CAST(report_json->>'$.k' AS DOUBLE), 0) AS k_metric,
       CAST(report_json->>'$.absent' AS DOUBLE) AS absent_metric
FROM audits ORDER BY created_at DESC, audit_id DESC LIMIT 20""")
def recent_dashboard(spark, d):
    """The newest rows with figures picked out of the stored JSON."""
    newest = store.newest(audits(spark, d), ["created_at", "audit_id"], 20)
    report = F.try_parse_json("report_json")
    return rounded(
        newest.select(
            "audit_id", F.substring("report_json", 1, 100).alias("preview"), "audit_type", "trust",
            F.coalesce(F.try_variant_get(report, "$.k", "double"), F.lit(0.0)).alias("k_metric"),
            F.try_variant_get(report, "$.absent", "double").alias("absent_metric"),
        )
    )


@job("stale_audits", "D4 D5", f"""WITH {AUDITS}
SELECT audit_id, date_diff('day', CAST(created_at AS DATE), DATE '2024-07-10') > 180 AS stale,
       CAST(created_at AS DATE) + CAST(k AS INT) < DATE '2024-02-15' AS expired
FROM audits""")
def stale_audits(spark, d):
    """Staleness against a given day, and retention dates that have passed by another."""
    as_of = F.lit("2024-07-10").cast("date")
    rows = audits(spark, d).withColumn("keep_until", F.date_add(F.to_date("created_at"), F.col("k")))
    gone = store.expired(rows, "keep_until", F.lit("2024-02-15").cast("date")).select("audit_id", F.lit(True).alias("_gone"))
    return rows.join(gone, "audit_id", "left").select(
        "audit_id", store.is_stale(F.to_date("created_at"), as_of).alias("stale"), F.coalesce("_gone", F.lit(False)).alias("expired")
    )


def _reports(spark, d):
    """A report document per model output, with many citations of varying length."""
    o = outputs(spark, d)
    words = F.split("output", " ")
    snippets = F.transform(words, lambda w: F.concat(w, F.lit(" "), F.col("output")))
    cites = F.transform(
        snippets,
        lambda s: F.struct(F.lit("t").alias("title"), F.lit("s").alias("source"), F.lit(0.5).alias("similarity"), s.alias("snippet"), s.alias("source_text")),
    )
    checked = F.transform(snippets, lambda s: F.struct(s.alias("claim"), F.lit("Unverifiable").alias("verdict"), s.alias("source_text")))
    return o.select(
        "conv_id", "turn", "output",
        F.struct(
            F.concat_ws("-", "conv_id", "turn").alias("audit_id"), F.lit("llm").alias("audit_type"), F.lit(0.5).alias("trust_score"),
            F.col("output").alias("input_text"), F.repeat("output", 3).alias("corrections"),
            F.lit(0.0).alias("elapsed_seconds"), F.lit(True).alias("requires_human_review"),
            F.struct(F.lit(0.5).alias("bias_score")).alias("bias"),
            F.struct(F.lit(0.5).alias("truth_score"), cites.alias("citations"), checked.alias("claim_citations")).alias("truth"),
            F.struct(F.lit(0.5).alias("cluster_fairness")).alias("cluster"),
            F.struct(F.lit(0.5).alias("distribution_stability")).alias("distribution"),
            F.array(F.struct(F.lit("r").alias("regulation"))).alias("regulatory_flags"),
        ).alias("report"),
    )


@job("compacted_reports", "S12 C26", f"""WITH {OUTPUTS}
SELECT conv_id, turn, CASE WHEN length(output) > 500 THEN left(output, 500) || '...' ELSE output END AS input_text,
       CASE WHEN length(output) * 3 > 1200 THEN left(output || output || output, 1200) || '...' ELSE output || output || output END AS corrections,
       least(len(string_split(output, ' ')), 5) AS n_citations,
       CASE WHEN length(string_split(output, ' ')[1] || ' ' || output) > 220 THEN left(string_split(output, ' ')[1] || ' ' || output, 220) || '...'
            ELSE string_split(output, ' ')[1] || ' ' || output END AS first_snippet,
       true AS within_cap
FROM outputs""")
def compacted_reports(spark, d):
    compact = _reports(spark, d).withColumn("json", store.compact_report(F.col("report")))
    parsed = F.from_json(
        "json", "input_text string, corrections string, truth struct<citations:array<struct<snippet:string>>>"
    )
    return compact.withColumn("p", parsed).select(
        "conv_id", "turn", F.col("p.input_text").alias("input_text"), F.col("p.corrections").alias("corrections"),
        F.size("p.truth.citations").cast("bigint").alias("n_citations"),
        F.element_at("p.truth.citations", 1)["snippet"].alias("first_snippet"),
        (F.length("json") <= K.REPORT_CHARS).alias("within_cap"),
    )


@job("minimal_reports", "S12", f"""WITH {OUTPUTS}
SELECT conv_id, turn, 'minimal' AS storage_policy, true AS drops_texts, least(len(string_split(output, ' ')), 5) AS n_citations FROM outputs""")
def minimal_reports(spark, d):
    """With a small cap every report falls back to its short form."""
    short = _reports(spark, d).withColumn("json", store.compact_report(F.col("report"), cap=100))
    return short.select(
        "conv_id", "turn", F.get_json_object("json", "$.storage_policy").alias("storage_policy"),
        F.get_json_object("json", "$.input_text").isNull().alias("drops_texts"),
        F.size(F.from_json("json", "truth struct<citations:array<struct<snippet:string>>>")["truth"]["citations"]).cast("bigint").alias("n_citations"),
    )


@job("report_documents", "S13 J2", f"""WITH {AUDITS}, {REVIEWS},
last AS (SELECT audit_id, max(review_id) AS review_id, arg_max(status, review_id) AS status FROM reviews GROUP BY audit_id)
SELECT a.audit_id, a.audit_type, CAST(a.k AS VARCHAR) AS report_k, l.status AS review_status, CAST(l.review_id AS VARCHAR) AS review_id
FROM audits a LEFT JOIN last l USING (audit_id)""")
def report_documents(spark, d):
    """One JSON document per audit, written as lines and read back."""
    path = scratch_path(spark, "reports")
    reports.write_reports(reports.report_rows(audits(spark, d), reviews(spark, d)), path)
    back = spark.read.text(path)
    return back.select(
        F.get_json_object("value", "$.audit.audit_id").cast("bigint").alias("audit_id"),
        F.get_json_object("value", "$.audit.audit_type").alias("audit_type"),
        F.get_json_object("value", "$.report.k").alias("report_k"),
        F.get_json_object("value", "$.review.review_status").alias("review_status"),
        F.get_json_object("value", "$.review.review_id").alias("review_id"),
    )


@job("chain_verification", "D6", """SELECT event_id, seq, seq = 0 OR CAST(props->>'$.k' AS INT) >= 10 AS intact FROM events, (SELECT unnest([0, 1, 2]) AS seq)""")
def chain_verification(spark, d):
    """A hash-chained log of three entries per event; in some the middle one was changed."""
    from plumbline.sources.tables import load

    payloads = [F.concat("event_type", F.lit(f"-{i}")) for i in range(3)]
    h0 = F.sha2(F.concat_ws("|", F.lit(""), payloads[0]), 256)
    h1 = F.sha2(F.concat_ws("|", h0, payloads[1]), 256)
    h2 = F.sha2(F.concat_ws("|", h1, payloads[2]), 256)
    changed = F.get_json_object("props", "$.k").cast("int") < 10
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("seq"), p.alias("payload"), h.alias("hash"))
            for i, (p, h) in enumerate(zip(payloads, (h0, F.when(changed, "changed").otherwise(h1), h2)))
        ]
    )
    log = load(spark, d, "events").select("event_id", "ts", F.inline(entries))
    return store.verify_chain(log, "event_id", ["ts", "seq"], F.col("payload")).select("event_id", "seq", "intact")


ENTRIES = f"""{AUDITS},
e AS MATERIALIZED (SELECT tenant, audit_id, k, audit_type || '-' || k AS payload, segment, row_number() OVER (PARTITION BY tenant, segment ORDER BY created_at, audit_id) AS step
  FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY tenant) > 40
                  THEN CAST((row_number() OVER (PARTITION BY tenant ORDER BY created_at, audit_id) - 1) // 40 + 1 AS INT) ELSE 0 END AS segment FROM audits))"""
CHAIN = f"""WITH RECURSIVE {ENTRIES},
chain(tenant, audit_id, segment, step, hash) AS (
  SELECT tenant, audit_id, segment, step, sha256('|' || payload) FROM e WHERE step = 1
  UNION ALL
  SELECT e.tenant, e.audit_id, e.segment, e.step, sha256(c.hash || '|' || e.payload) FROM chain c JOIN e ON e.tenant = c.tenant AND e.segment = c.segment AND e.step = c.step + 1)"""
SEALS = f"""{CHAIN}, heads AS MATERIALIZED (SELECT tenant, segment, arg_max(hash, step) || ':' || count(*) AS head, row_number() OVER (PARTITION BY tenant ORDER BY segment) AS place
  FROM chain GROUP BY tenant, segment),
seals(tenant, segment, head, place, seal) AS (
  SELECT tenant, segment, head, place, sha256('|' || head) FROM heads WHERE place = 1
  UNION ALL
  SELECT h.tenant, h.segment, h.head, h.place, sha256(s.seal || '|' || h.head) FROM seals s JOIN heads h ON h.tenant = s.tenant AND h.place = s.place + 1)"""
IN_ORDER = ["created_at", "audit_id"]


def _sealed_log(spark, d):
    """The audits of every tenant as a chain, in segments of forty where a tenant has more."""
    entries = audits(spark, d).select(
        "tenant", "audit_id", "created_at", "k", F.concat_ws("-", "audit_type", "k").alias("payload")
    )
    return store.build_chain(entries, "tenant", IN_ORDER, F.col("payload"), rows=40)


@job("chain_built", "D6", f"{CHAIN} SELECT tenant, audit_id, segment, hash FROM chain")
def chain_built(spark, d):
    return _sealed_log(spark, d)[0].select("tenant", "audit_id", "segment", "hash")


@job("chain_seals", "D6", f"{SEALS} SELECT tenant, segment, head, seal FROM seals")
def chain_seals(spark, d):
    return _sealed_log(spark, d)[1]


@job("sealed_chain_verification", "D6", f"""WITH {ENTRIES}
SELECT tenant, segment, count(*) AS entries, count_if(k < 10) AS broken, true AS sealed FROM e GROUP BY tenant, segment""")
def sealed_chain_verification(spark, d):
    """A log built above, with some payloads changed afterwards: their entries no longer link."""
    chain, seals = _sealed_log(spark, d)
    changed = chain.withColumn("payload", F.when(F.col("k") < 10, "changed").otherwise(F.col("payload")))
    return store.verify_sealed(changed, seals, "tenant", IN_ORDER, F.col("payload"))


@job("truncated_texts", "C26", "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS preview FROM documents")
def truncated_texts(spark, d):
    from plumbline.sources.tables import load

    return load(spark, d, "documents").select("doc_id", TX.truncate(F.col("text"), 500).alias("preview"))

"""The operators applied to whole tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, exact, html, lines, lm, mixing, near, pieces, quality, ranking, substrings, urls, whiten
from plumbline.llm.common import table

URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op1_lm_scores(spark, folder):
    return lm.score_documents(table(spark, folder, "documents"))


def op2_html_text(spark, folder):
    return html.extract_pages(table(spark, folder, "pages"))


def op3_mixed_sources(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents"))


def op4_repeated_passages(spark, folder):
    kept = substrings.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_url_verdicts(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, folder, "pages"), rules)


def op6_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_repeated_lines(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op8_exact_copies(spark, folder):
    return exact.exact_groups(table(spark, folder, "documents"))


def op9_benchmark_leaks(spark, folder):
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_near_duplicates(spark, folder):
    return near.near_duplicates(table(spark, folder, "documents"))


def op11_piece_ids(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    digests = (F.sha2(c, 256).alias(n) for c, n in ((F.col("ids"), "ids_sha256"), (F.col("decoded").cast("binary"), "decoded_sha256")))
    return coded.select("doc_id", "n_tokens", *digests)


def op12_whitened_embeddings(spark, folder):
    return whiten.whiten(table(spark, folder, "embeddings"))


def op13_ranked_documents(spark, folder):
    return ranking.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scores, op2_html_text, op3_mixed_sources, op4_repeated_passages, op5_url_verdicts, op6_quality, op7_repeated_lines, op8_exact_copies, op9_benchmark_leaks, op10_near_duplicates, op11_piece_ids, op12_whitened_embeddings, op13_ranked_documents)
}

SQL = {
    "op5_url_verdicts": r"""
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        split AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM (SELECT *, CASE
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
                END AS rule FROM split)
    """,
    "op8_exact_copies": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op13_ranked_documents": r"""
        WITH found AS (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        sizes AS (
            SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM found),
        asked AS (
            SELECT DISTINCT item, item_id, term FROM (
                SELECT item, item_id, unnest(terms) AS term FROM (
                    SELECT row_number() OVER () AS item, item_id,
                           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
                    FROM benchmark))),
        postings AS (
            SELECT row, doc_id, n, term, count(*) AS tf
            FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM found)
            WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), sizes),
        gains AS (
            SELECT row, doc_id, term,
                   w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))) AS gain
            FROM postings JOIN weights USING (term), sizes),
        scored AS (
            SELECT item, item_id, row, doc_id, CAST(sum(gain) AS BIGINT) AS score
            FROM asked JOIN gains USING (term) GROUP BY ALL HAVING sum(gain) > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored)
        WHERE rank <= 50
    """,
}

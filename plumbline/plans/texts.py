"""Claim, retrieval and correction jobs over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import text as TX
from plumbline.functions.chunks import chunks
from plumbline.operators import claims as CL
from plumbline.operators import correction as CR
from plumbline.operators import retrieval as R
from plumbline.operators.cells import search_cells, search_cells_approximately
from plumbline.operators.skew import join_to_unique
from plumbline.plans.inputs import (
    ARTICLES, OUTPUTS, SQL_WS, articles, outputs, sql_claims, sql_index, sql_strip, sql_support,
)
from plumbline.plans.registry import job, rounded
from plumbline.sources.tables import load

INDEX = f"{ARTICLES},\n{sql_index()}"


def _index(spark, d):
    return R.build_index(articles(spark, d), "kb_id", "content")


def _doc_claims(spark, d):
    return CL.explode_claims(load(spark, d, "documents"), ["doc_id"], "text")


def _turn_claims(spark, d):
    return CL.explode_claims(outputs(spark, d), ["conv_id", "turn"], "output")


DOC_CLAIMS = f"""claims AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, l[i] AS claim
  FROM (SELECT doc_id, {sql_claims('text')} AS l FROM documents), unnest(range(1, len(l) + 1)) u(i))"""
TURN_CLAIMS = f"""{OUTPUTS}, claims AS (SELECT conv_id, turn, CAST(i - 1 AS INT) AS pos, l[i] AS claim
  FROM (SELECT conv_id, turn, {sql_claims('output')} AS l FROM outputs), unnest(range(1, len(l) + 1)) u(i))"""


@job("document_claims", "X1", f"WITH {DOC_CLAIMS} SELECT doc_id, pos, claim FROM claims")
def document_claims(spark, d):
    return _doc_claims(spark, d)


@job("first_claims", "W5", f"WITH {TURN_CLAIMS} SELECT conv_id, turn, pos, claim FROM claims WHERE pos < 12")
def first_claims(spark, d):
    """A report of the first twelve claims of each output."""
    return CL.explode_claims(outputs(spark, d), ["conv_id", "turn"], "output", first=12)


@job("kb_vocabulary", "X2", f"WITH {INDEX} SELECT term, df, cf, round(idf, 9) AS idf FROM vocabulary")
def kb_vocabulary(spark, d):
    return rounded(_index(spark, d).vocabulary)


@job("kb_vocabulary_compat", "X2", f"WITH {ARTICLES},\n{sql_index(terms=K.VOCABULARY_SIZE)} SELECT term, df, cf, round(idf, 9) AS idf FROM vocabulary")
def kb_vocabulary_compat(spark, d):
    """The vocabulary of an index that keeps its most frequent terms only."""
    return rounded(R.build_index(articles(spark, d), "kb_id", "content", max_terms=K.VOCABULARY_SIZE).vocabulary)


@job("kb_term_weights", "X2 X3", f"WITH {INDEX} SELECT kb_id, term, round(w, 9) AS w FROM kb_weights")
def kb_term_weights(spark, d):
    return rounded(_index(spark, d).postings.select("kb_id", "term", "w"))


@job("document_term_weights", "X2 X4", f"""WITH {INDEX}, {sql_support('documents', 'doc_id', 'text')}
SELECT doc_id, term, round(w, 9) AS w FROM text_weights""")
def document_term_weights(spark, d):
    """Whole documents in the knowledge base's vocabulary."""
    return rounded(R.weigh(load(spark, d, "documents"), ["doc_id"], "text", _index(spark, d)))


@job("document_term_weights_by_head", "X2 X4", f"""WITH {INDEX}, {sql_support('documents', 'doc_id', 'text')}
SELECT doc_id, term, round(w, 9) AS w FROM text_weights""")
def document_term_weights_by_head(spark, d):
    """The same with a small head of the dictionary, as for one too large to broadcast: the tail is shuffled."""
    return rounded(R.weigh(load(spark, d, "documents"), ["doc_id"], "text", _index(spark, d), head_terms=500))


@job("claim_support", "X4 X5 J4 W4", f"""WITH {INDEX}, {DOC_CLAIMS}, {sql_support('claims', 'doc_id, pos', 'claim')}
SELECT doc_id, pos, round(groundedness, 9) AS groundedness, round(truth, 9) AS truth FROM support""")
def claim_support(spark, d):
    """Every claim of every document against the knowledge base."""
    scored = R.score_claims(_doc_claims(spark, d), ["doc_id", "pos"], "claim", _index(spark, d))
    return rounded(scored.drop("hits"))


@job("claim_hits", "W4 J4 X7", f"""WITH {INDEX}, {TURN_CLAIMS}, {sql_support('claims', 'conv_id, turn, pos', 'claim')}
SELECT conv_id, turn, pos, CAST(rank AS INT) AS rank, kb_id, round(sim, 4) AS similarity, title, source,
  CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS snippet
FROM hits JOIN articles USING (kb_id)""")
def claim_hits(spark, d):
    """Ranked citations of every claim; passages without a shared term fill the ranks."""
    keys = ["conv_id", "turn", "pos"]
    hits = R.sparse_hits(_turn_claims(spark, d), keys, "claim", _index(spark, d))
    cited = CR.cite(hits, articles(spark, d), keys)
    return cited.select(*keys, "rank", "kb_id", "similarity", "title", "source", "snippet")


@job("claim_hits_in_blocks", "W4 J4", f"""WITH {INDEX}, {TURN_CLAIMS}, {sql_support('claims', 'conv_id, turn, pos', 'claim')}
SELECT conv_id, turn, pos, CAST(rank AS INT) AS rank, kb_id, round(sim, 9) AS sim FROM hits""")
def claim_hits_in_blocks(spark, d):
    """The same search in an index of many small blocks: bounds leave most of them unread."""
    index = R.build_index(articles(spark, d), "kb_id", "content", block_passages=8)
    hits = R.sparse_hits(_turn_claims(spark, d), ["conv_id", "turn", "pos"], "claim", index, local_postings=0)
    return rounded(hits.select("conv_id", "turn", "pos", "rank", "kb_id", "sim"))


@job("support_without_articles", "X6", f"WITH {TURN_CLAIMS} SELECT conv_id, turn, pos, CAST(0 AS DOUBLE) AS groundedness, CAST(0.5 AS DOUBLE) AS truth FROM claims")
def support_without_articles(spark, d):
    empty = articles(spark, d).filter(F.lit(False))
    index = R.build_index(empty, "kb_id", "content")
    return R.score_claims(_turn_claims(spark, d), ["conv_id", "turn", "pos"], "claim", index).drop("hits")


VERDICTS = """verdicts AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN quality = 1 THEN ' supported ' ELSE 'maybe' END AS raw FROM labels)"""

JUDGED = f"""{INDEX}, {DOC_CLAIMS}, {sql_support('claims', 'doc_id, pos', 'claim')}, {VERDICTS},
judged AS (SELECT doc_id, pos, groundedness, verdict, vs, least(1.0, greatest(0.0, 0.4 * groundedness + 0.6 * vs)) AS claim_truth FROM (
  SELECT doc_id, pos, groundedness, CASE WHEN raw = 'CONTRADICTED' THEN 'Contradicted' WHEN raw = ' supported ' THEN 'Supported' ELSE 'Unverifiable' END AS verdict,
         CAST(CASE WHEN raw = 'CONTRADICTED' THEN 0 WHEN raw = ' supported ' THEN 1 ELSE 0.4 END AS DOUBLE) AS vs
  FROM support LEFT JOIN verdicts USING (doc_id)))"""


def _judged(spark, d):
    raw = F.when(F.col("toxic") == 1, "CONTRADICTED").when(F.col("quality") == 1, " supported ").otherwise("maybe")
    verdicts = load(spark, d, "labels").select("doc_id", raw.alias("raw"))
    scored = R.score_claims(_doc_claims(spark, d), ["doc_id", "pos"], "claim", _index(spark, d))
    return CL.judge(scored.join(verdicts, "doc_id", "left"), F.col("raw"))


@job("judged_claims", "X8 X9 X10", f"""WITH {JUDGED}
SELECT doc_id, pos, verdict, round(claim_truth, 9) AS claim_truth, claim_truth < 0.65 AS hallucinated FROM judged""")
def judged_claims(spark, d):
    return rounded(_judged(spark, d).select("doc_id", "pos", "verdict", "claim_truth", "hallucinated"))


@job("verdict_sources", "X9", f"""WITH {INDEX}, {TURN_CLAIMS}, {sql_support('claims', 'conv_id, turn, pos', 'claim')},
named AS (SELECT conv_id, turn, pos, CASE WHEN pos % 7 <> 3 THEN pos % 6 - 1 END AS source_doc FROM claims),
sizes AS (SELECT conv_id, turn, pos, max(rank) AS n FROM hits GROUP BY ALL)
SELECT conv_id, turn, pos, CAST(source_doc AS INT) AS source_doc, kb_id, title, source, left(content, 220) AS source_text
FROM named JOIN sizes USING (conv_id, turn, pos) JOIN hits USING (conv_id, turn, pos) JOIN articles USING (kb_id)
WHERE rank = least(greatest(coalesce(source_doc, 1), 1), n)""")
def verdict_sources(spark, d):
    """The passage that a verdict names by its place among the hits; a place out of range moves to the nearest."""
    keys = ["conv_id", "turn", "pos"]
    scored = R.score_claims(_turn_claims(spark, d), keys, "claim", _index(spark, d))
    # stands in for the place a verdict gives, with missing ones and ones out of range
    named = scored.withColumn("source_doc", F.when(F.col("pos") % 7 != 3, F.col("pos") % 6 - 1).cast("int"))
    chosen = named.select(*keys, "source_doc", CL.cited(F.col("hits"), F.col("source_doc"))["kb_id"].alias("kb_id"))
    kb = articles(spark, d).select("kb_id", "title", "source", F.substring("content", 1, 220).alias("source_text"))
    return join_to_unique(chosen, kb, "kb_id", keys, "inner")


@job("text_truth", "A26 X8 X15", f"""WITH {JUDGED},
r AS (SELECT doc_id, count(*) AS n_claims, count(*) FILTER (claim_truth < 0.65) AS n_hallucinated, avg(claim_truth) AS avg_truth, avg(groundedness) AS g, avg(vs) AS v FROM judged GROUP BY doc_id)
SELECT doc_id, n_claims, n_hallucinated, round(avg_truth, 9) AS avg_truth, round(g, 9) AS avg_groundedness, round(v, 9) AS avg_verdict,
  round(n_hallucinated / n_claims, 9) AS hallucination_rate, round(least(1, greatest(0, 0.4 * g + 0.6 * v)), 9) AS text_truth FROM r""")
def text_truth(spark, d):
    return rounded(CL.roll_up(_judged(spark, d), ["doc_id"]))


AUDITED = f"""{INDEX}, {TURN_CLAIMS}, {sql_support('claims', 'conv_id, turn, pos', 'claim')},
judged AS (
  SELECT c.conv_id, c.turn, c.pos, c.claim, groundedness, least(1.0, greatest(0.0, 0.4 * groundedness + 0.6 * 0.4)) AS claim_truth, left(content, 220) AS passage
  FROM claims c JOIN support s ON s.conv_id = c.conv_id AND s.turn = c.turn AND s.pos = c.pos
  JOIN hits h ON h.conv_id = c.conv_id AND h.turn = c.turn AND h.pos = c.pos AND h.rank = 1 JOIN articles a ON a.kb_id = h.kb_id),
totals AS (
  SELECT conv_id, turn, count(*) AS n_claims, count(*) FILTER (claim_truth < 0.65) AS n_hallucinated, avg(claim_truth) AS avg_truth,
    list(struct_pack(find := claim, put := '[CORRECTED] ' || passage) ORDER BY pos) FILTER (claim_truth < 0.65) AS edits
  FROM judged GROUP BY ALL),
scored AS (SELECT *, n_hallucinated / n_claims AS rate, greatest(0.05, 1 - n_hallucinated / n_claims) AS conf FROM totals),
audited AS (
  SELECT t.*, o.output, 0.4 * avg_truth + 0.4 * 0.5 + 0.2 * conf AS trust_before,
    0.4 * least(1, avg_truth + 0.25 * rate) + 0.4 * 0.5 + 0.2 * least(1, conf + 0.1) AS trust_after,
    list_reduce(list_prepend(struct_pack(find := '', put := o.output), coalesce(edits, [])), lambda acc, e: struct_pack(find := '', put :=
      CASE WHEN position(e.find IN acc.put) > 0 THEN left(acc.put, position(e.find IN acc.put) - 1) || e.put || substring(acc.put, position(e.find IN acc.put) + length(e.find)) ELSE acc.put END)).put AS corrected
  FROM scored t JOIN outputs o USING (conv_id, turn))"""


@job("output_audit", "X10 X11 X14 A26 C3 C9", f"""WITH {AUDITED}
SELECT conv_id, turn, n_claims, n_hallucinated, round(avg_truth, 9) AS avg_truth, round(rate, 9) AS hallucination_rate, round(trust_before, 9) AS trust_before,
  round(trust_after, 9) AS trust_after, round(trust_after - trust_before, 9) AS trust_delta, trust_after < 0.6 AS requires_review, corrected FROM audited""")
def output_audit(spark, d):
    """The whole audit of assistant turns, corrected texts included."""
    audited = CR.audit_outputs(outputs(spark, d), ["conv_id", "turn"], "output", articles(spark, d), _index(spark, d))
    return rounded(
        audited.select(
            "conv_id", "turn", "n_claims", "n_hallucinated", "avg_truth", "hallucination_rate", "trust_before", "trust_after",
            "trust_delta", "requires_review", "corrected",
        )
    )


CORRECTED = f"""{INDEX}, {OUTPUTS}, {sql_support('outputs', 'conv_id, turn', 'output')},
corrected AS (
  SELECT o.conv_id, o.turn, output, s.groundedness, s.truth, h.sim, CASE WHEN h.sim >= 0.05 THEN '[CORRECTED] According to ' || title || ': ' ||
    CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END ELSE '[UNVERIFIED] ' || output END AS corrected
  FROM outputs o JOIN support s ON s.conv_id = o.conv_id AND s.turn = o.turn JOIN hits h ON h.conv_id = o.conv_id AND h.turn = o.turn AND h.rank = 1 JOIN articles a ON a.kb_id = h.kb_id)"""


@job("corrected_texts", "X12 X13 T7", f"""WITH {CORRECTED}
SELECT conv_id, turn, round(truth, 9) AS truth, round(sim, 9) AS best_sim, corrected FROM corrected""")
def corrected_texts(spark, d):
    """Whole texts rewritten from their best citation."""
    fixed = CR.correct_texts(outputs(spark, d), ["conv_id", "turn"], "output", articles(spark, d), _index(spark, d))
    return rounded(fixed.select("conv_id", "turn", "truth", "best_sim", "corrected"))


@job("reevaluated_texts", "C8 C7 C9", f"""WITH {CORRECTED},
first AS (SELECT conv_id, turn, corrected, 0.4 * truth + 0.4 * 0.5 + 0.17 AS trust FROM corrected),
again AS (SELECT conv_id AS c, turn AS t, corrected FROM first WHERE trust < 0.7),
{sql_support('again', 'c, t', 'corrected').replace('text_words', 'w2').replace('text_terms', 't2').replace('text_weights', 'v2').replace('sims', 's2').replace('hits', 'h2').replace('support', 'p2')}
SELECT conv_id, turn, round(trust, 9) AS trust, round(CASE WHEN trust < 0.7 THEN 0.4 * p2.truth + 0.4 * (1 - 0.3) + 0.17 ELSE trust END, 9) AS final_trust,
  CASE WHEN trust < 0.7 THEN 0.4 * p2.truth + 0.4 * (1 - 0.3) + 0.17 ELSE trust END < 0.6 AS requires_review
FROM first LEFT JOIN p2 ON c = conv_id AND t = turn""")
def reevaluated_texts(spark, d):
    """Second pass over the texts that were not approved, after correction."""
    from plumbline.functions import scores

    index = _index(spark, d)
    keys = ["conv_id", "turn"]
    fixed = CR.correct_texts(outputs(spark, d), keys, "output", articles(spark, d), index)
    trust = scores.trust_score(F.col("truth"), F.lit(K.TEXT_NEUTRAL), F.lit(K.DEFAULT_CONFIDENCE))
    first = fixed.select(*keys, "corrected", F.lit(K.TEXT_NEUTRAL).alias("bias"), trust.alias("trust"))
    first = first.withColumn("decision", scores.decision(F.col("trust")))
    return rounded(CR.reevaluate(first, keys, index).select(*keys, "trust", "final_trust", "requires_review"))


@job("scored_once", "P19 X5", f"""WITH {INDEX}, {sql_support('documents', 'doc_id', 'text')}
SELECT doc_id, round(groundedness, 9) AS groundedness, round(truth, 9) AS truth FROM support""")
def scored_once(spark, d):
    """Copies of a document are scored once and share the result."""
    index = _index(spark, d)
    docs = load(spark, d, "documents").select("doc_id", "text")
    scored = R.score_once(docs, ["doc_id"], "text", lambda df, keys, column: R.score_claims(df, keys, column, index).drop("hits"))
    return rounded(scored.select("doc_id", "groundedness", "truth"))


DENSE = """pairs AS (SELECT q.vec_id AS q_id, k.vec_id AS kb_id, list_inner_product(q.v, k.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(k.v, k.v))) AS sim
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) k WHERE q.vec_id <> k.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(sim, 9) DESC, kb_id) AS rank FROM pairs)"""


# Smaller cells than the exact search has: their bounds part near from far more finely.
APPROXIMATE_ROWS = 1_024


def _vectors(spark, d, ident):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias(ident), R.normalise(F.col("embedding")).alias("v"))


NEAREST = "SELECT q_id, kb_id, round(sim, 9) AS sim, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3"


@job("dense_neighbours", "J3 X16 X3 W4", f"WITH {DENSE} {NEAREST}")
def dense_neighbours(spark, d):
    """Exact top three of every vector against all others."""
    return rounded(search_cells(_vectors(spark, d, "q_id"), _vectors(spark, d, "kb_id"), exclude_self=True))


@job("dense_neighbours_in_blocks", "J3 X16", f"WITH {DENSE} {NEAREST}")
def dense_neighbours_in_blocks(spark, d):
    """The same with small cells and few queries per copy, as for sides that fill many tasks."""
    hits = search_cells(_vectors(spark, d, "q_id"), _vectors(spark, d, "kb_id"), exclude_self=True, query_rows=200, passage_rows=50)
    return rounded(hits)


@job("dense_support", "X5 X16", f"""WITH {DENSE}
SELECT q_id, round(sum(sim) / 3, 9) AS groundedness, round(least(sum(sim) / 3 / 0.6, 1), 9) AS truth FROM ranked WHERE rank <= 3 GROUP BY q_id""")
def dense_support(spark, d):
    queries = _vectors(spark, d, "q_id")
    hits = search_cells(queries, _vectors(spark, d, "kb_id"), exclude_self=True)
    scored = R.support(hits, ["q_id"], queries.count() - 1, K.DENSE_TRUTH_AT)
    return rounded(scored.drop("hits"))


def _asked(spark, d):
    """The stated queries of a search: every row whose id is divisible by 20, against all rows."""
    return _vectors(spark, d, "q_id").filter("q_id % 20 = 0")


@job("nearest_by_cells", "J3 X16", f"WITH {DENSE} {NEAREST} AND q_id % 20 = 0")
def nearest_by_cells(spark, d):
    """Exact top three of the stated queries against all other vectors."""
    return rounded(search_cells(_asked(spark, d), _vectors(spark, d, "kb_id"), exclude_self=True))


def _approximate(spark, d):
    return search_cells_approximately(_asked(spark, d), _vectors(spark, d, "kb_id"), exclude_self=True, passage_rows=APPROXIMATE_ROWS)


@job("approximate_neighbours", "X16")
def approximate_neighbours(spark, d):
    """Top three of the stated queries from the cells with the best bounds only."""
    return rounded(_approximate(spark, d))


@job("approximate_recall", "X16", f"""WITH {DENSE}
SELECT count(*) AS n_exact, count(DISTINCT q_id) AS n_queries, TRUE AS recall_reached FROM ranked WHERE rank <= 3 AND q_id % 20 = 0""")
def approximate_recall(spark, d):
    """How much of the exact top three the approximate search finds: nine tenths at least."""
    exact = search_cells(_asked(spark, d), _vectors(spark, d, "kb_id"), exclude_self=True).select("q_id", "kb_id")
    found = _approximate(spark, d).select("q_id", "kb_id", F.lit(1).alias("hit"))
    return exact.join(found, ["q_id", "kb_id"], "left").agg(
        F.count(F.lit(1)).alias("n_exact"), F.countDistinct("q_id").alias("n_queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_reached"),
    )


@job("document_chunks", "D3", f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '{SQL_WS}+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, CAST(i AS INT) AS chunk, array_to_string(ws[i * 462 + 1 : i * 462 + 512], ' ') AS words
FROM w, unnest(range(0, CAST(floor(greatest(len(ws) - 51, 0) / 462) AS BIGINT) + 1)) u(i) WHERE len(ws) > 0""")
def document_chunks(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk", "words"))

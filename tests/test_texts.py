"""Claims, retrieval, correction and redaction on small texts."""

import math
import re

import pytest
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import text as TX
from plumbline.functions.chunks import chunks
from plumbline.operators import claims as CL
from plumbline.operators import correction as CR
from plumbline.operators import quality, store
from plumbline.operators import retrieval as R

KB = [
    (1, "Water", "Water boils at one hundred degrees at sea level", "book"),
    (2, "Iron", "Iron melts at high heat; iron rusts in water", "book"),
    (3, "Moon", "The moon circles the earth in twenty seven days", "web"),
]


@pytest.fixture(scope="module")
def kb(spark):
    return spark.createDataFrame(KB, "kb_id bigint, title string, content string, source string").cache()


def claims_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(TX.claims(F.col("t")).alias("c")).first().c


@pytest.mark.parametrize("text, want", [
    ("One. Two!  Three? Four", ["One", "Two", "Three", "Four"]),
    ("no break at all", ["no break at all"]),
    ("same. same. same.", ["same", "same", "same."]),
    ("  padded \t.   next\n", ["padded", "next"]),
    ("3.14 stays. v1.2 too.", ["3.14 stays", "v1.2 too."]),
    ("   ", []),
    ("", []),
])
def test_claim_split(spark, text, want):
    assert claims_of(spark, text) == want
    assert [c.strip() for c in re.split(r"[.!?]\s+", text) if c.strip()] == want


def brute_force(texts, k):
    """Support by dense tf-idf over the whole vocabulary."""
    def words(t):
        return [w for w in re.findall(r"(?u)\b\w\w+\b", t.lower()) if w not in K.STOP_WORDS]

    def terms(t):
        ws = words(t)
        return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]

    docs = [terms(c) for _, _, c, _ in KB]
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1

    def vector(ts):
        v = {t: ts.count(t) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in set(ts) if t in df}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    matrix = [vector(d) for d in docs]
    out = {}
    for i, t in texts:
        q = vector(terms(t))
        sims = [sum(q.get(w, 0) * x for w, x in d.items()) for d in matrix]
        order = sorted(range(len(docs)), key=lambda j: (-sims[j], j))[:k]
        out[i] = ([KB[j][0] for j in order], sum(sims[j] for j in order) / min(k, len(docs)))
    return out


def test_support_against_brute_force(spark, kb):
    texts = [(0, "Water boils at sea level"), (1, "iron rusts"), (2, "nothing known here"), (3, ""), (4, "the moon and the water of the earth")]
    df = spark.createDataFrame(texts, "i int, t string")
    for k in (2, 3):
        want = brute_force(texts, k)
        for passages in (R.BLOCK_PASSAGES, 1):
            index = R.build_index(kb, "kb_id", "content", block_passages=passages)
            hits = R.sparse_hits(df, ["i"], "t", index, k=k, local_postings=0 if passages == 1 else R.LOCAL_POSTINGS)
            got = {r.i: r for r in R.support(hits, ["i"], index.n_docs, K.SPARSE_TRUTH_AT, k).collect()}
            assert set(got) == {0, 1, 2, 3, 4}
            for i, (ids, grounded) in want.items():
                assert [h.kb_id for h in got[i].hits] == ids
                assert got[i].groundedness == pytest.approx(grounded)
                assert got[i].truth == pytest.approx(min(grounded / 0.18, 1))


def test_fewer_articles_than_k(spark, kb):
    index = R.build_index(kb.filter("kb_id = 1"), "kb_id", "content")
    row = R.score_claims(spark.createDataFrame([(0, "water boils")], "i int, t string"), ["i"], "t", index).first()
    assert len(row.hits) == 1 and row.groundedness == pytest.approx(row.hits[0].sim)


def test_unbounded_vocabulary_gives_the_same(spark, kb):
    df = spark.createDataFrame([(0, "Water boils at sea level"), (1, "iron")], "i int, t string")
    a, b = (R.score_claims(df, ["i"], "t", R.build_index(kb, "kb_id", "content", max_terms=m)).orderBy("i").collect() for m in (4096, None))
    assert [r.groundedness for r in a] == pytest.approx([r.groundedness for r in b])


def test_verdicts(spark):
    df = spark.createDataFrame([(" supported ",), ("CONTRADICTED",), ("who knows",), (None,)], "v string")
    got = [r[0] for r in df.select(CL.normalise_verdict(F.col("v"))).collect()]
    assert got == ["Supported", "Contradicted", "Unverifiable", "Unverifiable"]


def test_cited_source_is_clamped(spark):
    df = spark.createDataFrame([([1, 2, 3], i) for i in (-4, 0, 1, 3, 9)] + [([], 1)], "h array<int>, i int")
    assert [r[0] for r in df.select(CL.cited(F.col("h"), F.col("i"))).collect()] == [1, 1, 1, 3, 3, None]


def test_output_audit_replaces_first_occurrences(spark, kb):
    text = "Cheese is blue. Water boils at one hundred degrees. Cheese is blue."
    outputs = spark.createDataFrame([(1, text)], "i int, o string")
    index = R.build_index(kb, "kb_id", "content")
    row = CR.audit_outputs(outputs, ["i"], "o", kb, index).first()
    assert (row.n_claims, row.n_hallucinated, row.hallucination_rate) == (3, 3, 1.0)
    # literal and in order: the second claim is first found inside the first replacement
    want = text
    for claim in ("Cheese is blue", "Water boils at one hundred degrees", "Cheese is blue."):
        want = want.replace(claim, "[CORRECTED] " + KB[0][2], 1)
    assert row.corrected == want
    assert row.trust_before == pytest.approx(0.4 * row.avg_truth + 0.2 + 0.2 * 0.05)
    assert row.trust_after == pytest.approx(0.4 * min(1, row.avg_truth + 0.25) + 0.2 + 0.2 * 0.15)


def test_supported_claims_stay(spark, kb):
    outputs = spark.createDataFrame([(1, "Water boils at one hundred degrees at sea level")], "i int, o string")
    index = R.build_index(kb, "kb_id", "content")
    row = CR.audit_outputs(outputs, ["i"], "o", kb, index, verdict=F.lit("supported")).first()
    assert row.n_hallucinated == 0 and row.corrected == "Water boils at one hundred degrees at sea level"


def test_whole_text_correction(spark, kb):
    texts = spark.createDataFrame([(1, "iron rusts in water"), (2, "zzz qqq")], "i int, o string")
    got = {r.i: r.corrected for r in CR.correct_texts(texts, ["i"], "o", kb, R.build_index(kb, "kb_id", "content")).collect()}
    assert got == {1: f"[CORRECTED] According to Iron: {KB[1][2]}", 2: "[UNVERIFIED] zzz qqq"}


def test_redaction(spark):
    cells = ["mail a.b+c@x-y.org now", "ssn 123-45-6789 or 123456789", "call +1 (555) 123-4567 or 555.123.4567", "id 12345678901234", None, ""]
    df = spark.createDataFrame([(c,) for c in cells], "t string")

    def python(value):
        for pattern in (K.EMAIL_PATTERN, K.SSN_PATTERN, K.PHONE_PATTERN):
            value = re.sub(pattern, K.REDACTED, value)
        return value

    assert [r.t for r in quality.redact(df).collect()] == [c and python(c) for c in cells]
    counts = quality.personal_data_counts(df, "t").first()
    assert (counts.emails, counts.ssns, counts.phones) == (1, 2, 2)


def test_formula_cells(spark):
    df = spark.createDataFrame([("=1",), ("  @x",), ("\t+1",), ("a=1",), ("",), (None,)], "t string")
    assert [r.t for r in quality.sanitise(df).collect()] == ["\t=1", "\t  @x", "\t+1", "a=1", "", None]
    assert quality.injection_counts(df).first().flagged_cells == 3
    assert quality.injection_rows(df).count() == 3


def test_cleaning(spark):
    df = spark.createDataFrame([(" nan ",), ("None",), ("",), (" x ",), ("　null",), (None,)], "t string")
    assert [r[0] for r in df.select(TX.clean(F.col("t"))).collect()] == [None, None, None, "x", None, None]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 974, 975, 3000])
def test_chunks_cover_the_text(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(chunks(F.col("t")).alias("c")).first().c
    parts = [c.split(" ") for c in got]
    assert [w for i, p in enumerate(parts) for w in (p if i == 0 else p[50:])] == words
    assert all(len(p) == 512 for p in parts[:-1]) and all(len(p) <= 512 for p in parts)


def test_chain_verification(spark):
    import hashlib

    rows, before = [], ""
    for i in range(50):
        before = hashlib.sha256(f"{before}|p{i}".encode()).hexdigest()
        rows.append(("log", i, f"p{i}", before))
    rows[20] = ("log", 20, "tampered", rows[20][3])
    df = spark.createDataFrame(rows, "log string, seq int, payload string, hash string").withColumn("at", F.timestamp_seconds("seq"))
    checked = store.verify_chain(df, "log", ["at"], F.col("payload"))
    assert [r.seq for r in checked.filter("NOT intact").collect()] == [20]

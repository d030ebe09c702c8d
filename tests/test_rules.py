"""Scores, bands, rules and sources on literal values."""

import pytest
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import scores
from plumbline.operators import encode, feedback, models, profile, recommend, review, rules, store
from plumbline.sources import knowledge, matrix, registry, tables


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("truth, bias, want", [(1.0, 0.0, 0.97), (0.0, 1.0, 0.17), (0.24, 0.5, 0.466), (5.0, 0.0, 1.0)])
def test_trust_score(spark, truth, bias, want):
    assert one(spark, scores.trust_score(F.lit(truth), F.lit(bias), F.lit(0.85))) == pytest.approx(want)


def test_partial_weights_fall_back(spark):
    got = one(spark, scores.trust_score(F.lit(1.0), F.lit(0.0), F.lit(1.0), {"truth": 0.1}))
    assert got == pytest.approx(0.1 + 0.4 + 0.2)


def test_unknown_signal_stays_unknown(spark):
    assert one(spark, scores.trust_score(F.lit(None).cast("double"), F.lit(0.1), F.lit(0.5))) is None
    assert one(spark, scores.risk_band(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("trust, band, decision", [
    (0.49999, "critical", "correct"), (0.5, "elevated", "correct"), (0.6, "moderate", "correct"), (0.7, "moderate", "approve"), (0.75, "low", "approve")])
def test_bands(spark, trust, band, decision):
    assert one(spark, scores.risk_band(F.lit(trust))) == band
    assert one(spark, scores.decision(F.lit(trust))) == decision


def test_priority_counts_missing_as_zero(spark):
    none = F.lit(None).cast("double")
    assert one(spark, scores.severity(none, none, none)) == "critical"
    assert one(spark, scores.priority(none, none, none)) == 360.0
    assert one(spark, scores.priority(F.lit(1.0), F.lit(0.0), F.lit(1.0))) == 0.0


def test_framework_rows(spark):
    got = one(spark, rules.framework_status(F.lit(0.2), F.lit(0.4), F.lit(True)))
    assert {r.framework: r.status for r in got} == {
        "eeoc": "violation", "ecoa": "attention", "who": "violation", "eu_ai_act": "attention", "nist_ai_rmf": "attention", "gdpr": "attention"}
    calm = one(spark, rules.framework_status(F.lit(0.05), F.lit(0.9), F.lit(False)))
    assert {r.status for r in calm} == {"pass"} and len(calm) == 4


def test_weight_fold_step():
    assert review.next_weights((0.4, 0.4, 0.2), True) == (0.45, 0.35, 0.2)
    assert review.next_weights((0.0, 0.8, 0.2), False) == (0.0, 0.8095, 0.1905)


def test_feedback_thresholds(spark):
    rows = [(i < 6, i < 3) for i in range(10)]
    got = feedback.propose_weights(spark.createDataFrame(rows, "correct boolean, bias_flag boolean")).first()
    # 40 % incorrect raises truth; exactly 30 % biased does not raise bias
    assert (got.truth, got.bias, got.confidence) == (0.4286, 0.381, 0.1905)


def test_profile_and_roles(spark):
    rows = [("male", 30, ">50K", " nan "), ("female", 41, "<=50K", "x"), ("female", 52, "<=50K", "y")]
    df = spark.createDataFrame(rows, "gender string, age int, income string, note string")
    p = profile.profile(df)
    got = {r.column: (r.type, r.suggested_role, r.n_distinct) for r in p.collect()}
    assert got["gender"] == ("binary", "protected_attribute", 2)
    assert got["age"] == ("numeric", "feature", 3)
    assert got["note"] == ("binary", "target", 2)
    assert profile.infer_roles(p.filter("column <> 'note'")) == {"gender": "protected_attribute", "age": "feature", "income": "target"}
    # a table with columns of the wrappers' names
    assert profile.normalise_roles({"roles": "feature", "x": "target"}, ["roles", "x"]) == {"roles": "feature", "x": "target"}
    assert profile.normalise_roles({"columns": None, "x": "target"}, ["columns", "x"]) == {"columns": "feature", "x": "target"}
    assert profile.normalise_roles({"columns": [{"name": "age", "role": "ignore"}, {"name": "gender", "role": "wrong"}]}, ["age", "gender"]) == {
        "age": "ignore", "gender": "feature"}
    assert len(profile.check_roles({"gender": "target", "age": "protected_attribute"}, p)) == 1


def test_mapped_encoding(spark):
    rows = [("b", "yes", 1.0, "red"), ("a", "no", None, "blue"), ("b", "no", 5.0, None), ("a", "yes", 3.0, "green")]
    df = spark.createDataFrame(rows, "g string, y string, x double, c string")
    encoded, info = encode.encode_table(df, {"g": "protected_attribute", "x": "feature", "c": "feature", "y": "target"})
    assert info["features"] == ["g", "x", "c__blue", "c__green", "c__missing", "c__red"]
    assert [tuple(r) for r in encoded.collect()] == [
        (1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0), (0.0, 3.0, 1.0, 0.0, 0.0, 0.0, 0.0), (1.0, 5.0, 0.0, 0.0, 1.0, 0.0, 0.0), (0.0, 3.0, 0.0, 1.0, 0.0, 0.0, 1.0)]
    with pytest.raises(ValueError, match="exactly two"):
        encode.encode_table(df, {"g": "feature", "x": "feature", "c": "target"})


def test_recommendation(spark):
    rows = [("small", "text", 10), ("loans", "loan_amount", 500), ("loans", "race", 500), ("wide", "x", 5000)]
    got = {r.dataset: r for r in recommend.recommend(spark.createDataFrame(rows, "dataset string, column string, n_rows bigint")).collect()}
    assert (got["small"].domain, got["small"].depth, got["small"].review_priority) == ("general", "fast", "standard")
    # 'race' speaks for hiring, 'loan_amount' for finance: the tie goes to the first domain
    assert (got["loans"].domain, got["loans"].preset, got["loans"].review_priority, got["loans"].depth) == ("hiring", "hiring", "high", "standard")
    assert got["wide"].depth == "thorough"


def test_articles(spark):
    batch = spark.createDataFrame([(0, "long enough text"), (1, "short"), (2, "another long text")], "n bigint, Passage string")
    shaped = knowledge.normalise(batch, order="n")
    stored = spark.createDataFrame([("Article 3",)], "title string")
    assert [r.title for r in knowledge.new_articles(shaped, stored, "n").collect()] == ["Article 1"]
    with pytest.raises(ValueError):
        knowledge.normalise(spark.createDataFrame([("x",)], "other string"))


def test_matrix_text_mode(spark):
    df = spark.createDataFrame([("plain words",), ("[1, 2",), ('{"features": [[1, 2]], "labels": [1]}',)], "t string")
    got = [(r.mode, r.problem) for r in matrix.parse(df, "t").collect()]
    assert got == [("text", None), ("dataset", "invalid JSON"), ("dataset", None)]


def test_csv_sample_and_empty(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n3,z\n")
    assert tables.read_csv(spark, str(tmp_path / "t.csv"), rows=2).count() == 2
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "e.csv"))


def test_manifest(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes(b"hello")
    (tmp_path / "c.exe").write_bytes(b"x" * 100)
    got = {r.file: r for r in registry.manifest(spark, str(tmp_path), max_bytes=50).collect()}
    csv = next(r for name, r in got.items() if name.endswith(".csv"))
    assert csv.allowed and csv.sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert got["c.exe"].too_large and not got["c.exe"].allowed


def test_model_invariants(spark):
    df = spark.range(4000).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"), F.lit(1.0).alias("constant"),
    ).withColumn("y", (F.col("x") + 0.2 * F.col("g") > 0.6).cast("int"))
    features = ["g", "x", "constant"]
    found = models.bias_score(df, features, "y", "g", ["row_id"])
    assert found["bias"] == pytest.approx((found["parity"] + found["opportunity"]) / 2) and found["bias"] > 0.05
    assert sum(found["importance"].values()) == pytest.approx(1) and found["importance"]["constant"] == 0.0
    assert max(found["importance"], key=found["importance"].get) == "x"
    assert found == models.bias_score(df.repartition(3), features, "y", "g", ["row_id"])

    ready = models.assemble(df, features)
    model = models.train(ready, "y")
    explained = models.explain_rows(model, ready, features, ["row_id"])
    scored = models.predict(model, ready).select("row_id", "score").filter("score BETWEEN 1e-4 AND 1 - 1e-4")
    both = explained.join(scored, "row_id").select(F.abs(F.log(F.col("score") / (1 - F.col("score"))) - F.col("log_odds")).alias("d"))
    assert both.agg(F.max("d")).first()[0] < 1e-6
    assert all(c.share <= 1 for r in explained.limit(20).collect() for c in r.contributions)

    one_class = df.withColumn("y", F.lit(1))
    assert models.bias_score(one_class, features, "y", "g", ["row_id"])["bias"] == 0.0


def test_report_cap(spark):
    from plumbline import schemas

    rows = [("r", "x" * 700, ["s" * 300] * 8), ("q", "short", [])]
    df = spark.createDataFrame(rows, "audit_id string, input_text string, snippets array<string>")
    report = F.from_json(
        F.to_json(F.struct("audit_id", "input_text", F.struct(F.transform("snippets", lambda s: F.struct(s.alias("snippet"))).alias("citations")).alias("truth"))),
        schemas.REPORT,
    )
    got = df.select("audit_id", store.compact_report(report).alias("full"), store.compact_report(report, cap=50).alias("small")).collect()
    assert '"storage_policy":"compact"' in got[0].full and got[0].full.count("snippet") == 5 and "x" * 500 + "..." in got[0].full
    assert '"storage_policy":"minimal"' in got[0].small and "input_text" not in got[0].small
    assert len(got[0].full) <= K.REPORT_CHARS

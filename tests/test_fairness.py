"""Edge rules of the fairness and distribution metrics, on literal tables."""

import math
import statistics

import pytest

from plumbline.operators import fairness as FA
from plumbline.operators import moments, sampling


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_empty_group_counts_as_rate_zero(spark):
    df = table(spark, [(1, "a"), (0, "a")], "pred int, g string")
    row = FA.parity_gap(df, "pred", "g", "a", "b").first()
    assert (row.rate_first, row.rate_second, row.parity_gap) == (0.5, 0.0, 0.5)


def test_group_without_positives_has_tpr_zero(spark):
    df = table(spark, [(1, 1, "a"), (0, 1, "b")], "y int, pred int, g string")
    row = FA.opportunity_gap(df, "y", "pred", "g", "a", "b").first()
    assert (row.tpr_first, row.tpr_second, row.opportunity_gap) == (1.0, 0.0, 1.0)


@pytest.mark.parametrize("compat, flagged", [(False, True), (True, False)])
def test_total_exclusion(spark, compat, flagged):
    df = table(spark, [(0, "a")] * 4 + [(1, "b")] * 3 + [(0, "b")], "y int, g string")
    row = FA.bias_metrics(df, "y", "g", compat=compat).first()
    assert row.unprivileged == "a" and row.privileged == "b"
    assert row.impact_ratio == 0.0 and row.parity_difference == 0.75
    assert row.bias_detected and row.four_fifths_violated is flagged


def test_undefined_ratio(spark):
    df = table(spark, [(1, "a"), (0, "a"), (0, "b")], "y int, g string")
    assert FA.bias_metrics(df, "y", "g").first().impact_ratio is None
    assert FA.bias_metrics(df, "y", "g", compat=True).first().impact_ratio == 0.0


def test_one_label_or_one_group_is_degenerate(spark):
    for rows in ([(1, "a"), (1, "b")], [(1, "a"), (0, "a")]):
        row = FA.bias_metrics(table(spark, rows, "y int, g string"), "y", "g").first()
        assert (row.parity_difference, row.impact_ratio, row.status) == (0.0, 1.0, "degenerate")


def test_more_than_two_groups(spark):
    rows = [(1, "x"), (0, "x"), (1, "y"), (1, "z"), (0, "z"), (0, "z")]
    df = table(spark, rows, "y int, g string")
    pair = FA.bias_metrics(df, "y", "g").first()
    assert (pair.unprivileged, pair.privileged, pair.n_groups) == ("x", "y", 3)
    rest = {r.g: r.gap for r in FA.one_vs_rest(df, "y", "g").collect()}
    assert rest["y"] == pytest.approx(1 - 2 / 5)


def test_correlation_ties_and_constants(spark):
    rows = [(1.0, 1.0, 5.0, 1), (2.0, 2.0, 5.0, 0), (3.0, 3.0, 5.0, 1), (4.0, 4.0, 5.0, 1)]
    df = table(spark, rows, "a double, b double, c double, y int")
    row = FA.top_correlated(df, "y", ["b", "a", "c"]).first()
    assert row.top_feature == "b" and set(row.correlations) == {"a", "b"}


@pytest.mark.parametrize("n", range(0, 5))
def test_moments_of_few_values(spark, n):
    values = [1.0, 2.0, 4.0, 9.0][:n]
    row = moments.distribution_report(table(spark, [(v,) for v in values], "x double"), ["x"]).first()
    assert row.n == n
    assert row.stability == (0.5 if n < 4 else pytest.approx(row.stability))
    if n == 4:
        mean, s = statistics.fmean(values), statistics.stdev(values)
        m3 = sum((v - mean) ** 3 for v in values) / 4
        m2 = sum((v - mean) ** 2 for v in values) / 4
        assert row.skewness == pytest.approx(math.sqrt(12) / 2 * m3 / m2**1.5)
        assert row.std == pytest.approx(s)
    if n in (1, 2):
        assert row.skewness == 0.0 and row.kurtosis == 0.0


def test_constant_column_has_no_shape(spark):
    row = moments.distribution_report(table(spark, [(3.0,)] * 6, "x double"), ["x"]).first()
    assert row.skewness is None and row.stability is None


@pytest.mark.parametrize("n", [1, 2, 7, 5000, 5001])
def test_exact_median_in_passes(spark, n):
    df = spark.range(n).selectExpr("cast(pow(id, 3) % 1009 as double) / 7 as x", "cast(null as double) as none")
    want = statistics.median(((i**3) % 1009) / 7 for i in range(n))
    got = moments.medians(df, ["x", "none"])
    assert got["x"] == pytest.approx(want)
    assert got["none"] is None


def test_median_of_many_equal_values(spark):
    df = spark.range(30_000).selectExpr("case when id % 3 = 0 then cast(id as double) else 5e0 end as x")
    want = statistics.median(i if i % 3 == 0 else 5 for i in range(30_000))
    assert moments.medians(df, ["x"])["x"] == want


def test_median_beside_infinities_and_close_values(spark):
    inf, nan = math.inf, math.nan
    tiny = [1.0 + i * 2.0**-52 for i in range(9)]
    columns = {"one": [inf, 1.0, 2.0, -1e308, 1e308, nan, None], "most": [inf, inf, inf, 3.0, -inf, None, nan], "close": [*tiny[:7]]}
    rows = list(zip(*columns.values()))
    got = moments.medians(table(spark, rows, "one double, most double, close double"), list(columns))
    want = {c: statistics.median(x for x in v if x is not None and not math.isnan(x)) for c, v in columns.items()}
    assert got == want


def test_textbook_reweighing_equalises_rates(spark):
    rows = [("f", 1)] * 2 + [("f", 0)] * 8 + [("m", 1)] * 6 + [("m", 0)] * 4
    df = table(spark, rows, "g string, y int")
    weighed = sampling.reweigh(df, "g", "y", "f", factors={})
    rates = weighed.groupBy("g").agg({"weight": "sum"}).collect()
    by_rate = {
        r.g: r.r for r in weighed.selectExpr("g", "weight * y as wy", "weight as w").groupBy("g").agg({"wy": "sum", "w": "sum"})
        .selectExpr("g", "`sum(wy)` / `sum(w)` as r").collect()
    }
    assert len(rates) == 2
    assert by_rate["f"] == pytest.approx(0.4, abs=1e-6) and by_rate["m"] == pytest.approx(0.4, abs=1e-6)


def test_hash_split_ignores_partitioning(spark):
    ids = spark.range(2000)
    a = {r.id for r in sampling.hash_split(ids.repartition(3), "id").filter("is_train").collect()}
    b = {r.id for r in sampling.hash_split(ids.coalesce(1), "id").filter("is_train").collect()}
    assert a == b and 1500 < len(a) < 1700

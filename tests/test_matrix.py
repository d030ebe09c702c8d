"""JSON matrix payloads: what is said of odd ones, and how often a text is parsed."""

from plumbline.sources import matrix


def test_a_text_is_parsed_once(spark):
    good = '{"features": [[1, 2], [3, 4]], "labels": [0, 1], "protected_index": 1}'
    given = [(1, good), (2, None), (3, ""), (4, "plain"), (5, "{broken"), (6, good + " x"), (7, "[]"), (8, " " + good)]
    parsed = matrix.parse(spark.createDataFrame(given, "k int, t string"), "t")
    assert parsed.columns == ["k", "t", "matrix", "problem", "mode"]
    assert {r.k: (r.problem, r["mode"]) for r in parsed.collect()} == {
        1: (None, "dataset"), 2: ("invalid JSON", "text"), 3: ("empty input", "text"), 4: (None, "text"), 5: ("invalid JSON", "dataset"),
        6: (None, "dataset"), 7: ("features and labels are required", "dataset"), 8: (None, "dataset"),
    }
    rows = matrix.rows(parsed, "k")
    assert [(r.k, r.row, r.features, r.label, r.protected) for r in rows.orderBy("k", "row").collect()] == [
        (k, i, [1.0 + 2 * i, 2.0 + 2 * i], float(i), 2.0 + 2 * i) for k in (1, 6, 8) for i in (0, 1)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1

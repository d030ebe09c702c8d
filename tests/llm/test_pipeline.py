"""The pipeline's near-duplicate stage against brute force, and the whole run, on odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm.common import table

SCHEMA = "doc_id long, text string, source string, n_chars long"
A, B, C = (" ".join(f"{name}{i}" for i in range(60)) for name in "abc")
ROWS = [
    (1, A, "s", 0), (1, A, "s", 0), (1, A, "s", 0),  # exact repeated rows with the smallest key
    (2, A + " tail", "s", 0), (2, B, "s", 0),  # one key, two texts: one loses, the other is its class's only row
    (None, A, "t", 0), (None, C, "t", 0), (None, C + " end", "t", 0),  # null keys that lose, or win among themselves
    (7, None, "s", 0), (8, "", "s", 0), (9, "", "s", 0), (9, "two words", None, 0),
]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def winners(rows):
    """One row of each class of linked rows: the smallest key, null last."""
    sets, top = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                old = top[i]
                top = [top[j] if t == old else t for t in top]
    best = {}
    for i, row in enumerate(rows):
        if top[i] not in best or (row[0] is None, row[0] or 0) < (best[top[i]][0] is None, best[top[i]][0] or 0):
            best[top[i]] = row
    return best.values()


def names(rows):
    return sorted((str(r[0]), len((r[1] or "").split()), (r[1] or "")[:1]) for r in rows)


def test_one_row_of_each_class_stays(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = corpus_pipeline.keep_one_of_group(spark, docs, "").collect()
    want = names(winners(ROWS))
    # of null keys with the smallest order any one may stay: both texts of C are null-keyed
    close = lambda rows: [(k, min(n, 60), c) for k, n, c in rows]
    assert close(names(got)) == close(want)
    assert corpus_pipeline.keep_one_of_group(spark, docs.limit(0), "").count() == 0


def test_further_columns_stay_as_they_are(spark):
    names = ["_row", "_id", "_gone", "n_lines", "score", "predicted", "held_out", "id", "name"]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce("doc_id", F.lit(0)).cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns
        for r in got.collect():
            assert [r[n] for n in names] == [f"{n} of {r.doc_id or 0}" for n in names]


def test_stages_on_odd_rows(spark):
    folder = "/root/testdata/sf0.001"
    item = table(spark, folder, "benchmark").filter("text IS NOT NULL").first()["text"]
    rows = [*ROWS, (20, item, "s", 0), (21, f"{A}\nown line here", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert told(corpus_pipeline.drop_benchmark(spark, docs, folder)) == sorted(((r[0], r[1]) for r in rows if r[0] != 20), key=str)
    got = dict(told(corpus_pipeline.drop_lines(spark, docs.filter("doc_id > 6 OR doc_id = 1"), folder)))
    assert got == {1: A, 7: None, 8: "", 9: "two words", 20: item, 21: "own line here"} | ({9: got[9]})
    assert sorted(str(r.doc_id) for r in corpus_pipeline.mix(spark, docs, folder).collect()) == sorted(str(r[0]) for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_run_on_odd_rows(spark, tmp_path):
    bench = table(spark, "/root/testdata/sf0.001", "benchmark")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    rows = [*ROWS, (20, bench.first()["text"], "s", 0)]
    for n, docs in (("some", spark.createDataFrame(rows, SCHEMA)), ("none", spark.createDataFrame([], SCHEMA))):
        for name, df in (("documents", docs), ("labels", labels.limit(0)), ("benchmark", bench)):
            df.write.parquet(f"{tmp_path}/{n}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    ids = [r.doc_id for r in got]
    assert set(ids) <= {r[0] for r in rows} and 20 not in ids and {7, 8} <= set(ids)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

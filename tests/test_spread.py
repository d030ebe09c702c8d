"""Rows of a fit are dealt by their number, not by the cores alone."""

from plumbline.operators import models


def test_large_partitions_are_parted(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    parts = lambda df: df.rdd.getNumPartitions()
    df = spark.range(cores * 40, numPartitions=cores)
    assert parts(models.spread(df)) == cores
    monkeypatch.setattr(models, "SPREAD_ROWS", 10)
    spread = models.spread(df)
    assert parts(spread) == cores * 4 and spread.distinct().count() == cores * 40
    assert parts(models.spread(spark.range(4, numPartitions=2))) == cores and models.spread(df.limit(0)).count() == 0


def test_mitigation_computes_its_rows_once(spark):
    """A join below the rows is not done anew, with its broadcast, by each scan of the fits."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, float(i % 7), i % 3, i % 2, "a" if i % 5 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, "i long, x double, z int, y int, g string")
    given = models.assemble(df.mapInArrow(count, df.schema), ["x", "z"])
    found = models.mitigate(given, "i", "y", "g", "a", "b").collect()
    assert [r.stage for r in found] == ["before", "after"]
    assert seen.value <= 2 * len(rows)

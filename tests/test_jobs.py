"""Every registered job on the smallest tables, against its SQL where it has one."""

import pytest
from compare import connect, difference

from plumbline.plans import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_job(spark, con, name):
    job = REGISTRY[name]
    df = job.run(spark, FOLDER)
    if job.sql is None:
        assert df.count() > 0
    else:
        problem, _ = difference(df, con, job.sql)
        assert not problem, problem
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Drift of a stream in several batches against plain Python, with a hot tenant, equal times and a null tenant."""

import datetime as dt
import random

import pytest

from plumbline.streaming import jobs

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("piece", [20, 100_000])
def test_drift_over_batches(spark, tmp_path, piece):
    draw = random.Random(3)
    rows = [
        (draw.choice([1, 1, 2, 3, None]), START + dt.timedelta(minutes=i // 3), i, draw.choice([None, draw.random(), draw.random()]))
        for i in range(240)
    ]
    want = {}
    for tenant in {r[0] for r in rows}:
        last = []
        for _, _, ident, bias in (r for r in rows if r[0] == tenant and r[3] is not None):
            want[ident] = (tenant, bias, sum(last) / len(last) if last else bias)
            last = [*last, bias][-5:]
    folder = str(tmp_path / "events")
    schema = "tenant long, ts timestamp, audit_id long, bias double"
    for at in range(0, len(rows), 80):
        spark.createDataFrame(rows[at : at + 80], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r.audit_id: r for r in jobs.run_drift(stream, "test-drift", rows=piece).collect()}
    assert got.keys() == want.keys()
    for ident, (tenant, bias, baseline) in want.items():
        assert (got[ident].tenant, got[ident].bias) == (tenant, bias)
        assert got[ident].baseline == pytest.approx(baseline) and got[ident].delta == pytest.approx(bias - baseline)

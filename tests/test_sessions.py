"""Sessions of a stream against plain Python, with a hot key, null keys, pauses of exactly the gap and several batches."""

import datetime as dt
import random

from plumbline.streaming import jobs

START = dt.datetime(2024, 1, 1)


def sessions(rows):
    found = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key and t is not None)
        for t in times:
            if found and found[-1][0] == key and t < found[-1][2] + dt.timedelta(hours=1):
                found[-1] = (key, found[-1][1], t, found[-1][3] + 1)
            else:
                found.append((key, t, t, 1))
    newest = max((t for _, t in rows if t is not None), default=START)
    hour = dt.timedelta(hours=1)
    return sorted(((k, a, b + hour, n, b + hour > newest - hour) for k, a, b, n in found), key=str)


def test_open_and_closed_sessions(spark, tmp_path):
    draw = random.Random(5)
    rows = [(1, START + dt.timedelta(seconds=draw.randrange(90_000))) for _ in range(300)]
    rows += [(draw.choice([2, 3, None]), START + dt.timedelta(minutes=draw.randrange(3000))) for _ in range(300)]
    rows += [(4, START), (4, START + dt.timedelta(hours=1)), (4, START + dt.timedelta(hours=1, minutes=59)), (4, START + dt.timedelta(hours=1)), (5, None)]
    rows.sort(key=lambda r: (r[1] is None, r[1] or START))
    folder = str(tmp_path / "events")
    for at in range(0, len(rows), 200):  # a file and a batch each, in order of time
        spark.createDataFrame(rows[at : at + 200], "tenant long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("tenant long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    slots = jobs.run_updates(jobs.session_slots(stream, "tenant", late="3 days"), "test-slots", ["slot", "tenant"])
    got = jobs.join_slots(slots, "tenant").collect()
    assert sorted(((r.tenant, r.session_start, r.session_end, r.events, r.is_open) for r in got), key=str) == sessions(rows)
    assert jobs.join_slots(slots.limit(0), "tenant").count() == 0

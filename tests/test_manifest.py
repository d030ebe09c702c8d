"""The file manifest: large files are hashed in pieces, across tasks."""

import hashlib

import numpy as np

from plumbline.sources import registry


def test_files_in_pieces_hash_as_the_whole(spark, tmp_path, monkeypatch):
    for name, value in {"WHOLE": 1000, "LARGEST": 45_000, "PIECE": 50_000, "LONGEST_LINE": 30_000}.items():
        monkeypatch.setattr(registry, name, value)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rng = np.random.default_rng(7)
    some = lambda n: rng.integers(0, 256, n).astype(np.uint8).tobytes()
    mark, line = b"\xef\xbb\xbf", b"x" * 40_000
    files = {
        "a.bin": some(123_457) + b"x", "b c%20.bin": some(100_000) + b"\n", "d[1].bin": mark + some(70_001) + b"x", "e.bin": mark + some(70_001) + b"\n\n",
        "f.bin": b"\n" * 60_000, "g.bin": b"a\r\nb\r" * 20_000, "small.txt": b"hello", "plain.csv.gz": some(39_000), "line.bin": line, "line_in_long.bin": some(9_000) + line + some(9_000),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        got = {r.size_bytes: r for r in registry.manifest(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(files)
    for name, data in files.items():
        hashed = name != "line_in_long.bin"  # neither lines nor a cell of this size
        assert got[len(data)].sha256 == (hashlib.sha256(data).hexdigest() if hashed else None), name
        assert got[len(data)].too_large != hashed
    few = {r.size_bytes: r.sha256 for r in registry.manifest(spark, str(tmp_path), max_bytes=60_000).collect()}
    assert few[60_000] == got[60_000].sha256 and few[123_458] is None

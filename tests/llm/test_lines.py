"""Line dedup against brute force."""

import numpy as np

from plumbline.llm import lines
from plumbline.llm.common import table


def brute(rows):
    """rows: (key, text); all kept texts in order of input."""
    entries = []
    for at, (key, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            if words := set(line.encode().split()):
                entries.append((float("inf") if key is None else key, n, at, words))
    entries.sort(key=lambda e: e[:3])
    index, gone = {}, set()
    for i, (_, n, at, words) in enumerate(entries):
        seen = {j for w in words for j in index.get(w, ())}
        for j in seen:
            both = len(words & entries[j][3])
            if 10 * both >= 8 * (len(words) + len(entries[j][3]) - both):
                gone.add((at, n))
                break
        for w in words:
            index.setdefault(w, []).append(i)
    out = []
    for at, (key, text) in enumerate(rows):
        parts = (text or "").split("\n")
        kept = [p for n, p in enumerate(parts) if (at, n) not in gone]
        out.append((-1 if key is None else key, 0 if text is None else len(parts), len(parts) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


def run(df):
    got = lines.dedup_lines(df).select("doc_id", "n_lines", "n_removed", "text")
    return sorted(((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()), key=str)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == brute(rows)


def test_similar_lines_of_all_lengths(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(80)]
    base = [list(rng.choice(vocabulary, n)) for n in (1, 2, 4, 5, 6, 9, 10, 14, 20, 40, 70)]
    rows = []
    for i in range(250):
        text = []
        for _ in range(4):
            words = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(len(words))] = str(rng.choice(vocabulary))
            words += list(rng.choice(vocabulary, rng.integers(0, 2)))
            rng.shuffle(words)
            text.append(" ".join(words))
        rows.append((i, "\n".join(text)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark):
    rows = [(3, "a b c d e\n\nfoo"), (1, "a  b c d e f\n \n"), (2, None), (None, "foo\nbar"), (4, ""), (5, "bar"), (6, "q " * 40000 + "\nr s"), (7, "s\tr r")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, n_lines int")
    assert run(df) == brute(rows)
    assert lines.dedup_lines(df).columns == ["doc_id", "text", "row", "n_lines", "n_removed"]
    assert run(df.limit(0)) == []
    twice = spark.createDataFrame([(1, "a b\nc"), (1, "a b\nc"), (1, "c d\na b")], "doc_id long, text string")
    assert [r[3] for r in run(twice)] == ["a b\nc", "a b\nc", "c d"]


def test_words_in_order_by_line_rank_and_hash(monkeypatch):
    rng = np.random.default_rng(8)
    place = np.sort(rng.integers(0, 50, 4000))
    count = rng.integers(0, 3, 4000).astype(np.uint16)
    low = rng.integers(0, 4, 4000).astype(np.uint64)  # hashes that agree in their upper bits
    for hashes in (low, low << np.uint64(62), rng.integers(0, 1 << 63, 4000).astype(np.uint64)):
        for far in (0, 1 << 45):  # with and without room for a part of the hash
            order = lines._by_line(place + far, count, hashes)
            assert sorted(order) == list(range(4000))
            found = list(zip(place[order], count[order], hashes[order]))
            assert found == sorted(found)


def test_ranks_rise_with_counts():
    counts = np.unique(np.concatenate((np.arange(5000), 2 ** np.arange(40), 3 * 2 ** np.arange(40))))
    ranks = lines.ranks(counts).astype(int)
    assert (np.diff(ranks) >= 0).all() and ranks.max() < 1 << 12 and list(ranks[:128]) == list(range(128))


def test_lines_that_hold_a_wanted_token():
    text = np.frombuffer(b"a b c\n\nd e\nf a\ng\nh", np.uint8)
    offsets = np.array([0, 11, len(text)])
    every = lines.Lines(text, offsets, None)
    wanted = np.zeros(lines.SLOTS, bool)
    a = every.tokens[every.first[2] : every.first[2] + every.size[2]]  # those of "f a"
    wanted[(a & np.uint64(lines.SLOTS - 1)).astype(int)] = True
    some = lines.Lines(text, offsets, None, wanted)
    assert list(zip(some.doc, some.line, some.size)) == [(0, 0, 3), (1, 0, 2)]
    assert list(some.high) == [every.high[0], every.high[2]]
    assert not len(lines.Lines(text, offsets, None, np.zeros(lines.SLOTS, bool)).doc)

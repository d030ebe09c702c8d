"""Operators on single documents, URLs and pages, against brute force and defined odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact, html, lm, mixing, quality, urls
from plumbline.llm.common import table

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None, "a", 0.5), (2, "", "a", 0.5), (3, "x " * 50_000, None, 0.1), (3, "x y", "b", 0.1), (3, "x y", "b", 0.1), (None, "Ünï cödé", "c", 0.0), (5, "x y", "b", 0.2)]
ODD_SCHEMA = "doc_id long, text string, source string, score double"


def test_unigram_base_and_model(spark):
    docs = table(spark, FOLDER, "documents")
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.collect()]
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    counts = Counter(w for k, words in rows if not held[k] for w in words)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert len(got) == len(rows)
    for k, words in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(words), sum(w in counts for w in words), n)
        assert r.base_score == pytest.approx(base) and -20 * r.n_bytes < r.score < 0


def test_model_probabilities_of_all_continuations_sum_to_one():
    import numpy as np

    model = lm.Model(np.random.default_rng(1).normal(size=lm.SLOTS).astype(np.float16), np.zeros(lm.SLOTS, np.uint8), lm.fresh_weights(), np.full((lm.GATES, lm.STEPS), 0.4))
    coded = lm.encode(["", "a", "ab"])
    assert coded.bits.shape == (6, 8) and list(coded.word) == [0, 1, 1, 2, 2, 2] and list(coded.inside) == [0, 0, 1, 0, 1, 2]
    words = [""] + [chr(i) for i in range(1, 128) if i != 32]
    # words of one byte and the empty word are disjoint events
    assert 0 < (10.0 ** lm.score_words(model, words)).sum() <= 1


def test_lm_odd_rows(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = lm.score_documents(df).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) for r in got)
    assert lm.score_documents(df.limit(0)).count() == 0


def test_mix_follows_targets(spark):
    docs = table(spark, FOLDER, "documents")
    got = mixing.mix_sources(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in got}
    total, target, taken, largest = sum(sizes.values()), {}, Counter(), Counter()
    for r in got:
        assert r.size == sizes[r.doc_id] and r.taken in (0, r.size, 2 * r.size)
        target[r.source] = r.target
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.target <= 2 * r.source_size + 1e-6
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - target[s]) <= 2 * max(largest.values()) for s in target)
    assert sum(taken.values()) <= 1.5 * total
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_odd_rows(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_sources(df.filter("doc_id < 3")).collect()] == [0, 0]


def test_exact_groups(spark):
    long = "p" * 70_000
    rows = [(i, t) for i, t in enumerate(["a", "a", "", None, long + "x", long + "y", long + "x", "p" * 64, "p" * 65, "p" * 64, "é"])] + [(0, "a"), (None, "solo")]
    got = sorted(tuple(r) for r in exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("group_size", F.lit(9))).fillna(-1).collect())
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(-1 if k is None else k)
    expected = sorted((k, max(g), len(g), k == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g)
    assert got == expected
    assert exact.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("rows", [0, 400_000])
def test_urls(spark, monkeypatch, rows):
    monkeypatch.setattr("plumbline.llm.common.SMALL_ROWS", rows)
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    found = ["http://a.EXAMPLE.org/en/12", "https://example.org/es", "x://example.org/es/?q", "ftp://org", "http://notexample.org/en/1", "http://b.com/de/#x", "http://com/fr/", "no scheme", "", None, "http://x.com?a=/de/", "http://.org/", "http://a.org:80/x", "http://q.net/a://b.com/de/", "http://example.org/EN/1"] * 2
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string").withColumn("rule", F.lit("x"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(found)}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urls.filter_urls(pages, none).collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), none).count() == 0


def test_quality_on_held_out(spark):
    folder = "/root/testdata/sf0.1"  # 825 held-out labels, 122 of them junk
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = quality.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    clean = [r.predicted for r in got if r.quality == 1]
    junk = [r.predicted for r in got if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.2 * len(junk)
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    scored = quality.classify(df, labels.limit(0)).collect()
    assert len(scored) == len(ODD) and {r.score for r in scored} == {0.5}
    assert quality.classify(df.limit(0), labels).count() == 0


def test_long_hosts_and_many_rules(spark):
    rules = [(".".join(f"l{j}" for j in range(i, 0, -1)), f"/{'p' * (i % 7)}", ("allow", "block")[i % 2]) for i in range(1, 60)]
    long = ".".join(["x"] * 200_000)
    found = [f"http://{long}.l3.l2.l1/pppp", f"http://{long}/p", f"http://a.{rules[-1][0]}{rules[-1][1]}", "http://l1/" + "p" * 1_000_000, "http://..l2.l1/pp", "http://l2.l1", None]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(found)}


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &amp; simple", "plain & simple"),
    ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p><b>One,\n two</b> a&nbsp;b<br><p>Two<ul><li>x<li>y</ul></article><footer>f</footer>", "T\nOne, two a b\nTwo\nx\ny"),
    ("<body><div class='ad banner'>Buy, buy, buy</div><div id=main><p>A text, long enough.</p><form>mail</form><p>More &lt;p&gt; text</p></div><div id='comments'><p>First! " + "x, " * 200 + "</p></div>", "A text, long enough.\nMore <p> text"),
    ("<div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><div><p>Body text here.</div><script>var t='<p>no</p>'</script><!-- <p>no --><p hidden>no", "Body text here."),
    ("<article><p>Kept <em>inline</em> text <a title='x > y' href=z>link</a>.</p></article", "Kept inline text link.\n</article"),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_pages_keep_their_articles(spark):
    pages = table(spark, FOLDER, "pages")
    for r in html.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)

"""URL filter: a blocked Bloom filter of listed URL prefixes in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_checked

PROBES = 4
BITS_PER_RULE = 32
MAX_BLOCKS = 1 << 22


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters in lower case."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """``PROBES`` bits within one 64-bit block, drawn from a second hash of the key."""
    bits = F.xxhash64(key, F.lit("bits"))
    one = None
    for i in range(PROBES):
        at = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        one = bit if one is None else one.bitwiseOR(bit)
    return one


def bloom_blocks(rules: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as rows ``(block, bits)``; only blocks that hold a bit."""
    return rules.groupBy(_block(F.col(key), blocks).alias("_block")).agg(F.bit_or(_mask(F.col(key))).alias("_bits"))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL by the longest listed rule that fits it.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains if the URL's
    path starts with the rule's path. The longest rule (host and path together) wins; of two verdicts for the
    same rule, block. URLs that no rule fits get ``default``, the verdict for what no list names.

    Every (host suffix, path prefix) of a URL whose number of labels and path length some rule has is a key, so that
    long hosts cost no more than they have suffixes to try. Keys are first looked
    up in a blocked Bloom filter of the rules' keys (one 64-bit block per key); possible hits then meet the
    rules in an exact hash join, which drops false positives. A page is one row throughout, so hot hosts need
    no shuffle by host.

    Null URLs and those without ``://`` have empty host and path and get the default. Repeated rows are judged
    each for itself; other columns of ``pages`` are ignored. Empty tables give empty results, and without rules
    all URLs get the default.
    """
    keyed = rules.select(
        F.concat(F.coalesce("host", F.lit("")), F.lit("\n"), F.coalesce("path", F.lit(""))).alias("_key"),
        F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("_rule"),
        F.coalesce("verdict", F.lit("block")).alias("_verdict"),
        F.length(F.coalesce("path", F.lit(""))).alias("_length"),
        _labels(F.coalesce("host", F.lit(""))).alias("_labels"),
    ).filter(F.col("_rule") != "")
    listed = keyed.groupBy("_key", "_rule").agg(F.max(F.struct((F.col("_verdict") == "block").alias("b"), "_verdict"))["_verdict"].alias("_verdict"))
    stats = keyed.agg(F.count(F.lit(1)).alias("n"), F.collect_set("_length").alias("lengths"), F.collect_set("_labels").alias("labels")).first()
    blocks = max(1, min(MAX_BLOCKS, stats["n"] * BITS_PER_RULE // 64))
    u = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), url_host(u).alias("host"), url_path(u).alias("path"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    suffixes = F.array_compact(F.array(*[F.when(_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in sorted(stats["labels"])]))
    lengths = F.array(*[F.lit(x) for x in sorted(stats["lengths"])]) if stats["n"] else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda x: F.length("path") >= x), lambda x: F.substring(F.col("path"), F.lit(1), x))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    probed = rows.withColumn("_key", F.explode_outer(F.filter(keys, lambda k: ~k.startswith("\n"))))
    # at most MAX_BLOCKS rows of two longs
    bloom = F.broadcast(bloom_blocks(listed, "_key", blocks))
    probed = probed.withColumn("_block", _block(F.col("_key"), blocks)).join(bloom, "_block", "left")
    mask = _mask(F.col("_key"))
    possible = F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    # a key that the filter rules out gets one of its own, so that they spread in a shuffled join
    probed = probed.withColumn("_key", F.when(possible, F.col("_key")).otherwise(F.concat(F.lit("\n"), F.col("_row"))))
    hits = join_checked(probed, listed, "_key", "left")
    best = F.max(F.when(F.col("_rule").isNotNull(), F.struct(F.length("_rule").alias("n"), "_rule", "_verdict")))
    judged = hits.groupBy("_row", "page_id", "host", "path").agg(best.alias("_best"))
    return judged.select(
        "page_id", "host", "path", F.col("_best._rule").alias("rule"),
        F.coalesce("_best._verdict", F.lit(default)).alias("verdict"),
    )

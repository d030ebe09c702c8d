"""Exact dedup by distributed MSD radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise

FIRST_BYTES = 64
GROWTH = 16


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Group identical texts by their bytes and name the row of each group that stays.

    Level by level, groups are split by the next bytes of their documents: by the leading ``FIRST_BYTES`` at first,
    then by more. A group of one, or one whose texts end within the bytes compared, is finished; the rest gets group
    numbers, and the next level looks only at the bytes that follow, within its group. Most texts are left after a
    few bytes, and copies are compared to their end, each byte once. Groups are counted map-side, so a large group of
    copies costs its rows' next bytes once per task. Rows meet the counts in shuffled joins at every size: what a
    group's bytes weigh grows with the texts, and a broadcast of them would not be bounded. The hot groups' rows are
    split by the adaptive join. No digest decides; ``text_sha256`` is computed once and carried.

    Returns, per row of ``docs``: ``key``, ``keep_id`` (the largest key of the group), ``group_size``, ``kept``
    and ``text_sha256``. Null texts are empty texts. If the largest key occurs in several rows of a group, all of
    them are marked kept. A null key never stays beside another. Further columns are ignored; an empty table
    gives no rows.
    """
    left = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_body"), F.lit(0).cast("long").alias("_group"))
    left = left.withColumn("text_sha256", F.sha2("_body", 256))
    longest = docs.agg(F.max(F.octet_length(text)).alias("n")).first()["n"] or 0
    begin, end, done = 0, FIRST_BYTES, []
    split = ["_group", "_next", "_ended"]
    while True:
        left = left.withColumns({
            "_ended": F.octet_length("_body") <= end,
            "_next": F.substring("_body", begin + 1, end - begin),
        })
        groups = left.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"))
        several = materialise(groups.filter(F.col("_n") > 1).withColumn("_number", F.monotonically_increasing_id()), "radix-groups")
        joined = left.drop("_body").join(several.drop("_number").hint("merge"), split, "left")
        alone = F.col("_n").isNull()
        done.append(joined.filter(alone | F.col("_ended")).select(
            "_id", F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
            F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"), "text_sha256",
        ))
        if end >= longest:
            break
        # only what shares all its bytes so far with another text goes on, under the number of its group
        open_groups = several.filter(~F.col("_ended")).select("_group", "_next", "_number")
        left = left.filter(~F.col("_ended")).join(open_groups.hint("merge"), ["_group", "_next"])
        left = materialise(left.select("_id", "_body", F.col("_number").alias("_group"), "text_sha256"), "radix-level")
        begin, end = end, end * GROWTH
    rows = reduce(DataFrame.unionAll, done)
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    return rows.select(F.col("_id").alias(key), "keep_id", "group_size", kept.alias("kept"), "text_sha256")

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(v, comp)`` for every vertex of the undirected ``edges`` (a, b); ``comp`` is its component's smallest vertex.

    Each round links every vertex to the smallest one in its neighbourhood, which ends in one star per component
    after about log n rounds. Rounds are written to the shared folder; the smallest neighbour is found by a
    map-side aggregate, and no neighbourhood is ever gathered. Self loops and repeated edges do no harm.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = materialise(edges.filter("a <> b").select(most.alias("a"), least.alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
        ))).filter("a <> b").distinct()
        now = materialise(small, "stars")
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("v"), F.col("b").alias("comp")).unionByName(
        now.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct()
    )

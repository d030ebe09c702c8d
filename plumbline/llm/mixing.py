"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_checked, running_total
from plumbline.session import materialise

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: int) -> tuple[DataFrame, float]:
    """Targets of the sources in ``sizes`` (source, source_size), and their sum.

    Sources in code point order, null last, get the weights in turn. They share ``share`` times all sizes by
    weight; no target exceeds ``repeats`` times its source's size, and what a full source leaves goes to the
    others by weight. The common level rises until no source changes sides: one small aggregate each time.
    """
    ordered = sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(ordered, ["_null", "source"], "_one", "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * float(repeats))
    # what the sources before it hold, in the same order
    ranked = materialise(running_total(ranked, ["_null", "source"], "source_size", "_upto"), "sources")
    total = ranked.agg(F.sum("source_size").alias("n"), F.sum("_weight").alias("w")).first()
    budget = min(share, repeats) * float(total["n"] or 0)
    level = budget / total["w"] if total["w"] else 0.0
    while True:
        full = F.col("_cap") <= F.col("_weight") * F.lit(level)
        kept = ranked.agg(F.sum(F.when(full, F.col("_cap"))).alias("cap"), F.sum(F.when(~full, F.col("_weight"))).alias("w")).first()
        if not kept["w"]:
            break
        raised = (budget - (kept["cap"] or 0.0)) / kept["w"]
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("_cap"), F.col("_weight") * F.lit(level))
    return ranked.withColumn("target", target).withColumn("_before", F.col("_upto") - F.col("source_size")).drop("_one", "_rank"), budget


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2,
) -> DataFrame:
    """How many words of each document a mix with the given source weights takes.

    Documents of a source are shuffled by a hash of their key. Each pass over a document gets a virtual finish
    time: the words its source has sent by then, divided by the source's target. All passes are range-sorted by
    that time and taken until their words reach the budget, so that each source ends near its target. One source
    may hold most rows: its words are summed along the global order, never within one task.

    Returns ``key``, ``size``, ``source_size``, ``target`` and ``taken``, one row per row of ``docs``. A null or
    empty text has size 0 and gives 0. Rows with the same key are documents of their own; a null key sorts first.
    Null sources form one source, the last. Empty tables give no rows; further columns are ignored.
    """
    rows = docs.select(F.col(key).alias("_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = rows.withColumn("_null", F.col("source").isNull().cast("int"))
    rows = rows.withColumn("_key", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    sent = running_total(rows, ["_null", "source", "_key", "_id", "size"], "size", "_sent")
    sent = materialise(sent, "mix-rows")
    sizes = sent.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets, budget = source_targets(sizes, weights, share, repeats)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target", "_before")
    rows = join_checked(sent, targets, sent["source"].eqNullSafe(targets["_source"]), "inner")
    rows = rows.withColumn("_at", F.col("_sent") - F.col("_before"))

    def finish(turn: Column) -> Column:
        return F.when(F.col("target") > 0, (F.col("_at") + turn * F.col("source_size")) / F.col("target"))

    passes = rows.filter(F.col("size") > 0).select("_key", "_id", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda t: F.struct(finish(t).alias("f"), t.alias("t")))).alias("_p"))
    passes = passes.select("_p.f", "_p.t", "_key", "_id", "size")
    queue = running_total(passes, ["f", "_key", "_id", "t"], "size", "_queue")
    last = queue.filter(F.col("_queue") <= budget).agg(F.max(F.struct("f", "_key", "t")).alias("x")).first()["x"]
    taken = F.lit(0).cast("long")
    if last is not None:
        end = F.struct(F.lit(last["f"]).alias("f"), F.lit(last["_key"]).alias("k"), F.lit(last["t"]).alias("t"))
        for turn in range(repeats):
            at = F.struct(finish(F.lit(turn)).alias("f"), F.col("_key").alias("k"), F.lit(turn).alias("t"))
            taken = taken + F.when((F.col("size") > 0) & (at <= end), F.col("size")).otherwise(0)
    return rows.select(F.col("_id").alias(key), "size", "source_size", "target", taken.alias("taken"))

"""Streaming forms of the audit analytics.

Each function maps a streaming DataFrame to a streaming DataFrame; :func:`run_available`
drives one to completion into a parquet table in the shared folder. Event tables hold
``audit_id, tenant, ts, audit_type, trust, bias, truth`` or a subset.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline import constants as K
from plumbline.functions import scores, stats
from plumbline.operators.portfolio import drift_status
from plumbline.operators.review import DECIDED, START, next_weights
from plumbline.operators.skew import HOT_ROWS, with_preceding
from plumbline.session import scratch_path


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A parquet table as a stream, with NTZ times cast so that watermarks accept them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            stream = stream.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return stream


def kpi_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """KPIs per tumbling window and audit type; events later than the watermark are dropped
    and a window is emitted once it can no longer change."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "audit_type")
        .agg(
            F.count(F.lit(1)).alias("audits"),
            F.sum("trust").alias("trust_sum"),
            F.count("trust").alias("scored"),
            stats.count_where(F.col("trust") < K.BANDS["elevated"]).alias("high_risk"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "audit_type",
                "audits", "trust_sum", "scored", "high_risk")
    )


def rate_windows(events: DataFrame, key: str, width: str = "1 hour", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Events per key in overlapping windows, with the rate-limit flag."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width, slide), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "events",
                (F.col("events") >= K.API_CALLS_PER_HOUR).alias("over_limit"))
    )


def sessions(events: DataFrame, key: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions of user activity, closed after a pause."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "events")
    )


def session_slots(events: DataFrame, key: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """First and last time and number of events per key in slots as wide as a session's pause.

    Events of one slot are closer than the pause, so they are of one session; slots add up from any order of
    batches, and a key with a third of all events costs one row per slot. Events without a time are left out.
    """
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", gap), key)
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("slot"), key, "first", "last", "events")
    )


def join_slots(slots: DataFrame, key: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions from one row per key and slot, those included that later events may still prolong (``is_open``).

    A pause of exactly ``gap`` ends a session. Null keys are one key. No slots give no sessions.
    """
    pause = F.expr(f"INTERVAL {gap}")
    order = Window.partitionBy(key).orderBy("first")
    fresh = F.coalesce(F.col("first") >= F.lag("last").over(order) + pause, F.lit(True))
    told = slots.withColumn("_fresh", fresh).withColumn("_n", F.sum(F.col("_fresh").cast("long")).over(order))
    joined = told.groupBy(key, "_n").agg(
        F.min("first").alias("session_start"), (F.max("last") + pause).alias("session_end"), F.sum("events").alias("events")
    )
    closed = slots.agg((F.max("last") - F.expr(f"INTERVAL {late}")).alias("closed")).scalar()
    return joined.select("session_start", "session_end", key, "events", (F.col("session_end") > closed).alias("is_open"))


def deduplicated(events: DataFrame, key: str = "audit_id", late: str = "1 hour") -> DataFrame:
    """Each audit once, while copies arrive within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def scored(events: DataFrame, confidence: float = K.DEFAULT_CONFIDENCE) -> DataFrame:
    """Trust score, band and review flag of each event; stateless."""
    trust = scores.trust_score(F.col("truth"), F.col("bias"), F.lit(confidence))
    return (
        events.withColumn("trust", trust)
        .withColumn("risk", scores.risk_band(F.col("trust")))
        .withColumn("requires_review", scores.needs_review(F.col("trust")))
    )


DRIFT = "tenant bigint, ts timestamp, audit_id bigint, bias double, baseline double, delta double, status string"


def run_drift(events: DataFrame, name: str, history: int = K.DRIFT_HISTORY, rows: int = HOT_ROWS) -> DataFrame:
    """Bias of each audit against the mean of the tenant's ``history`` audits before it, over everything there is.

    The state is a table of the newest ``history`` audits per tenant, one version per batch. A batch meets it in a
    window cut into pieces for hot tenants, so no task holds a tenant's rows. Rows that arrive late are set in order
    of time among what the state holds. Audits without a bias are left out. A batch repeated after a failure reads
    the version before it and overwrites its own folders.
    """
    spark = events.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    columns = ["tenant", "ts", "audit_id", "bias"]
    usable = events.filter("bias IS NOT NULL").select(columns)

    def step(batch: DataFrame, n: int) -> None:
        seen = batch.sparkSession.read.schema(usable.schema).parquet(f"{state}/batch={n - 1}") if n else usable_none
        both = batch.withColumn("_new", F.lit(True)).unionByName(seen.withColumn("_new", F.lit(False)))
        told = with_preceding(both, ["tenant"], ["ts", "audit_id"], "bias", history, rows, out="baseline").filter("_new")
        told = told.select(*columns, F.coalesce("baseline", "bias").alias("baseline"))
        told = told.withColumn("delta", F.col("bias") - F.col("baseline"))
        told.withColumn("status", drift_status(F.round("delta", 4))).write.mode("overwrite").parquet(f"{out}/batch={n}")
        written = batch.sparkSession.read.schema(DRIFT).parquet(f"{out}/batch={n}").select(columns)
        newest = Window.partitionBy("tenant").orderBy(F.col("ts").desc(), F.col("audit_id").desc())
        kept = seen.unionByName(written).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= history)
        kept.drop("_r").write.mode("overwrite").parquet(f"{state}/batch={n}")

    usable_none = spark.createDataFrame([], usable.schema)
    query = (
        usable.writeStream.foreachBatch(step)
        .option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(DRIFT + ", batch bigint").parquet(out).drop("batch")


WEIGHTS = "tenant bigint, ts timestamp, review_id bigint, truth double, bias double, confidence double"


def weight_fold(decisions: DataFrame) -> DataFrame:
    """Running weights per tenant over approvals and rejections; the state is three numbers."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weights = tuple(state.get) if state.exists else START
        pdf = pd.concat(list(batches)).sort_values(["ts", "review_id"], ignore_index=True)
        seen = []
        for status in pdf["status"]:
            weights = next_weights(weights, status == "approved")
            seen.append(weights)
        state.update(weights)
        out = pdf[["ts", "review_id"]].copy()
        out.insert(0, "tenant", key[0])
        for i, name in enumerate(("truth", "bias", "confidence")):
            out[name] = [w[i] for w in seen]
        yield out

    usable = decisions.filter(F.col("status").isin(DECIDED)).select("tenant", "ts", "review_id", "status")
    return usable.groupBy("tenant").applyInPandasWithState(
        step, WEIGHTS, "truth double, bias double, confidence double", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over everything there is, into a parquet table, and return that table."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_updates(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run over everything there is, in update mode, and return the latest row per key: open windows too.

    Each batch overwrites its own folder, so one that is repeated after a failure counts once.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        .outputMode("update")
        .option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    newest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    rows = spark.read.schema(schema).parquet(out)
    return rows.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r", "batch")


def score_and_route(events: DataFrame, audits_path: str, queue_path: str, progress: str):
    """Score a stream into the audit table and, below the review line, the review queue.

    Batches may be repeated after a failure, so each writes below its own batch number and
    overwrites what an earlier try left there.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = scored(batch).persist()
        try:
            rows.write.mode("overwrite").parquet(f"{audits_path}/batch={batch_id}")
            queue = rows.filter("requires_review").select("audit_id", "trust", F.lit("pending").alias("status"))
            queue.write.mode("overwrite").parquet(f"{queue_path}/batch={batch_id}")
        finally:
            rows.unpersist()

    return (
        events.writeStream.foreachBatch(sink)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )

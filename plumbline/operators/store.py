"""The audit store: appends, latest rows, append-only guard, retention, report compaction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import constants as K
from plumbline.functions import text as TX
from plumbline.operators.skew import HOT_ROWS, with_preceding, with_time_bucket
from plumbline.session import materialise


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key. Each map task keeps one row per key before the shuffle."""
    spec = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(spec)).filter("_r = 1").drop("_r")


def append_audits(path: str, batch: DataFrame, limits: Mapping[str, int] | None = None) -> None:
    """Append audits with whole texts, or cut to ``limits`` characters per column."""
    cut = {c: TX.truncate(F.col(c), n) for c, n in (limits or {}).items()}
    (batch.withColumns(cut) if cut else batch).write.mode("append").parquet(path)


def split_updates(incoming: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Append-only guard: rows with a new key, and rows that would change a stored one."""
    known = stored.select(key)
    return incoming.join(known, key, "left_anti"), incoming.join(known, key, "left_semi")


def newest(df: DataFrame, order: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows, overall or per tenant (a report of fixed length)."""
    latest_first = [F.col(c).desc() for c in order]
    if not by:
        return df.orderBy(*latest_first).limit(n)
    spec = Window.partitionBy(*by).orderBy(*latest_first)
    return df.withColumn("_r", F.row_number().over(spec)).filter(F.col("_r") <= n).drop("_r")


def pruned(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """Rows outside the newest ``n``; the kept keys number at most ``n``."""
    kept = newest(df, order, n).select(key)
    return df.join(F.broadcast(kept), key, "left_anti")


def expired(df: DataFrame, until: str, as_of: Column) -> DataFrame:
    """Rows whose retention date has passed."""
    return df.filter(F.col(until) < as_of)


def is_stale(ts: Column, as_of: Column, days: int = 180) -> Column:
    return F.datediff(as_of, ts) > days


def compact_report(report: Column, cap: int = K.REPORT_CHARS) -> Column:
    """A parsed report as bounded JSON: shortened strings, five citations and claims; the
    long texts go altogether where the JSON would still exceed ``cap`` characters.

    ``report`` has the fields of :data:`plumbline.schemas.REPORT`.
    """
    truth = report["truth"]
    cites = F.transform(
        F.slice(truth["citations"], 1, 5),
        lambda c: c.withField("snippet", TX.truncate(c["snippet"], 220)).withField(
            "source_text", TX.truncate(c["source_text"], 220)
        ),
    )
    checked = F.transform(
        F.slice(truth["claim_citations"], 1, 5),
        lambda c: c.withField("source_text", TX.truncate(c["source_text"], 220)),
    )
    short_truth = truth.withField("citations", cites).withField("claim_citations", checked)
    compact = (
        report.withField("input_text", TX.truncate(report["input_text"], 500))
        .withField("corrections", TX.truncate(report["corrections"], 1200))
        .withField("truth", short_truth)
        .withField("storage_policy", F.lit("compact"))
    )
    minimal = (
        report.dropFields("input_text", "corrections", "elapsed_seconds", "requires_human_review", "regulatory_flags")
        .withField("truth", short_truth)
        .withField("storage_policy", F.lit("minimal"))
    )
    full = F.to_json(compact)
    return F.when(F.length(full) > cap, F.to_json(minimal)).otherwise(full)


def verify_chain(
    df: DataFrame, log: str | Sequence[str], order: Sequence[str], payload: Column, first: str = "", link: str = "hash"
) -> DataFrame:
    """Check a hash-chained log: each entry's ``link`` must be sha256(previous | payload).

    Only the neighbour is needed, so verification is a lag, not a fold; a log of any
    length is checked in pieces.
    """
    keys = [log] if isinstance(log, str) else list(log)
    linked = with_preceding(df, keys, order, link, 1, agg=F.max, out="_before")
    expected = F.sha2(F.concat_ws("|", F.coalesce("_before", F.lit(first)), payload), 256)
    return linked.withColumn("intact", F.coalesce(F.col(link) == expected, F.lit(False))).drop("_before")


def _chained(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: str, link: str) -> DataFrame:
    """Add the chain of each key: sorted rows stream through, and a task remembers one digest."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    # the window leaves each key's rows together and in order
    marked = df.withColumn("_begins", first)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = ""
        for batch in batches:
            links = []
            for begins, text in zip(batch.column("_begins").to_pylist(), batch.column(payload).to_pylist()):
                entry = "" if begins else at
                at = hashlib.sha256((entry if text is None else f"{entry}|{text}").encode()).hexdigest()
                links.append(at)
            kept = batch.drop_columns(["_begins"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(links, pa.string())], names=[*kept.schema.names, link])

    return marked.mapInArrow(walk, T.StructType([*df.schema.fields, T.StructField(link, T.StringType())]))


def _head(order: Sequence[str]) -> Column:
    """The last hash and the length of a segment, as the text its seal covers."""
    return F.concat_ws(":", F.max_by("hash", F.struct(*order)), F.count(F.lit(1)))


def build_chain(
    entries: DataFrame, log: str, order: Sequence[str], payload: Column, rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Hash-chain each log in the order given: (entries with ``segment`` and ``hash``, ``seals``).

    A log of more than ``rows`` entries is cut into segments that are chained in parallel, each from an empty link.
    The seals chain the segments: one (log, segment, head, seal) each, over its last hash and length,
    so that entries cut off at a segment's end, or whole segments gone or moved, show too. A null payload adds nothing to the
    link before it; entries of a null log are a log. Equal places in ``order`` are chained in any order, but once for all.
    """
    cut, _ = with_time_bucket(entries.withColumn("_payload", payload.cast("string")), [log], order, rows)
    linked = _chained(cut.withColumnRenamed("_bucket", "segment"), [log, "segment"], order, "_payload", "hash")
    chain = materialise(linked.drop("_payload"), "chain")
    seals = _chained(chain.groupBy(log, "segment").agg(_head(order).alias("head")), [log], ["segment"], "head", "seal")
    return chain, seals


def verify_sealed(chain: DataFrame, seals: DataFrame, log: str, order: Sequence[str], payload: Column) -> DataFrame:
    """One row per segment: entries found, entries that do not link, and whether its seal holds."""
    found = verify_chain(chain, [log, "segment"], order, payload).groupBy(log, "segment").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("intact")).alias("broken"), _head(order).alias("now")
    )
    linked = verify_chain(seals, log, ["segment"], F.col("head"), link="seal").withColumnRenamed("intact", "linked")
    # stacked rather than joined: a null log meets its own seals
    both = found.unionByName(linked.drop("seal"), allowMissingColumns=True).groupBy(log, "segment")
    sealed = F.max("linked") & (F.max("head") == F.max("now"))
    return both.agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("entries", "broken")],
        F.coalesce(sealed, F.lit(False)).alias("sealed"),
    )

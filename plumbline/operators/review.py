"""The human-review queue: enrichment, triage, decisions and the weight fold they drive."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import constants as K
from plumbline.functions import scores
from plumbline.operators.skew import HOT_ROWS, join_null_safe, join_to_unique, with_time_bucket
from plumbline.operators.store import latest
from plumbline.session import materialise

STATUSES = ["pending", "approved", "rejected", "escalated"]
DECIDED = ["approved", "rejected"]


def enrich(reviews: DataFrame, audits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reviews with their audit's columns; reviews of unknown audits stay, with nulls.

    One audit may draw very many reviews, hence the skew-safe join.
    """
    return join_to_unique(reviews, audits.select("audit_id", *columns), "audit_id", ["review_id"])


def with_latest_review(audits: DataFrame, reviews: DataFrame) -> DataFrame:
    """Audits with the status of their last review, where they have one."""
    last = reviews.groupBy("audit_id").agg(
        F.max_by("status", "review_id").alias("review_status"), F.max("review_id").alias("review_id")
    )
    return audits.join(last, "audit_id", "left")


def routed(df: DataFrame, preview_chars: int = 200) -> DataFrame:
    """Queue rows for audits below the review line."""
    return df.filter(scores.needs_review(F.col("trust"))).select(
        "audit_id",
        "trust",
        F.substring("input", 1, preview_chars).alias("input_preview"),
        F.lit("pending").alias("status"),
    )


def decisions_to_rejects(decisions: DataFrame, audits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid decisions, and rejects: unknown audit, or a rejection without notes."""
    known = audits.select("audit_id", F.lit(True).alias("_known"))
    marked = join_to_unique(decisions, known, "audit_id", ["review_id"])
    no_notes = (F.col("status") == "rejected") & (F.coalesce(F.col("notes"), F.lit("")) == "")
    reason = F.when(F.col("_known").isNull(), "unknown audit").when(no_notes, "rejection needs notes")
    marked = marked.withColumn("reason", reason).drop("_known")
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def current_status(decisions: DataFrame, order: Sequence[str]) -> DataFrame:
    """State of each review as its last decision left it."""
    return latest(decisions, ["audit_id"], order)


def status_counts(reviews: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return reviews.groupBy(*by).agg(*counts)


def triage(df: DataFrame, trust: str = "trust", bias: str = "bias", truth: str = "truth") -> DataFrame:
    """Severity, priority, urgency, impact, reviewer and action for every queue row."""
    t, b, f = (F.coalesce(F.col(c), F.lit(0.0)) for c in (trust, bias, truth))
    sev = F.col("severity")
    unfair, untrue = b >= 0.15, f < 0.70
    reviewer = F.when(unfair & (b >= 1 - f), "fairness lead").when(untrue, "domain expert").otherwise("product owner")
    action = (
        F.when(sev == "critical", "reject or escalate")
        .when((sev == "high") & unfair, "escalate for mitigation")
        .when(sev == "high", "reject until grounded")
        .when(sev == "medium", "approve with monitoring")
        .otherwise("approve")
    )
    impact = (
        F.when((sev == "critical") & unfair, "high: legal exposure")
        .when(sev == "critical", "high: false or unsafe output")
        .when(sev == "high", "elevated")
        .when(sev == "medium", "moderate")
        .otherwise("low")
    )
    urgency = (
        F.when(sev == "critical", "4 hours").when(sev == "high", "24 hours").when(sev == "medium", "this week")
        .otherwise("routine")
    )
    return (
        df.withColumn("severity", scores.severity(F.col(trust), F.col(bias), F.col(truth)))
        .withColumn("priority", scores.priority(F.col(trust), F.col(bias), F.col(truth)))
        .withColumn("urgency", urgency)
        .withColumn("impact", impact)
        .withColumn("reviewer", F.concat(reviewer, F.when(sev == "critical", " + compliance sign-off").otherwise("")))
        .withColumn("action", action)
    )


def risk_labels(trust: Column, bias: Column, truth: Column) -> Column:
    """Short labels shown beside a queue row."""
    found = F.array_compact(
        F.array(
            F.when(truth < 0.5, "low truth"),
            F.when(bias > 0.6, "high bias"),
            F.when(trust < 0.5, "low trust"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("marginal"))).otherwise(found)


def prioritised(triaged: DataFrame, position: str) -> DataFrame:
    """Pending rows by priority, the others after them in their old order, numbered."""
    return triaged.orderBy(*queue_order(position))


def queue_order(position: str) -> list[Column]:
    pending = F.col("status") == "pending"
    return [pending.desc(), F.when(pending, F.col("priority")).desc_nulls_last(), F.col(position).asc()]


def queue_summary(triaged: DataFrame, position: str = "review_id") -> DataFrame:
    """Severity counts, pending total, averages and the pending audit to look at first."""
    pending = F.col("status") == "pending"
    # equal priorities: the row that stands first in the queue wins
    first = F.max_by(
        F.when(pending, F.col("audit_id")),
        F.when(pending, F.struct(F.col("priority"), -F.col(position).cast("bigint"))),
    )
    return triaged.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")],
        F.count_if(pending).alias("pending_total"),
        F.count_if(~pending).alias("reviewed_total"),
        F.avg("trust").alias("mean_trust"),
        first.alias("top_audit_id"),
    )


# --- the weight fold -------------------------------------------------------------------
#
# Every approval moves 0.05 of weight from bias to truth, every rejection moves it back;
# then weights are scaled to sum to one and rounded to four places. Rounding at each step
# makes the result depend on the exact order, so it is a fold over the tenant's history.
# It can still run in pieces: rounding leaves a finite set of weights, so a piece of
# history is a function on that set, and functions compose. A short piece's function is
# written as its decisions, one bit each; from ``LISTED`` decisions on its table is shorter.

NAMES = ("truth", "bias", "confidence")
START = tuple(K.DEFAULT_WEIGHTS[n] for n in NAMES)
STEP = 0.05
LISTED = 1 << 15


def next_weights(weights: tuple, approved: bool) -> tuple:
    move = STEP if approved else -STEP
    moved = (max(0.0, weights[0] + move), max(0.0, weights[1] - move), weights[2])
    total = sum(moved)
    return tuple(round(w / total, 4) for w in moved) if total > 0 else weights


def reachable(start: tuple = START) -> tuple[list[tuple], np.ndarray]:
    """All weights any history can lead to (about 61,000), and the step table on them."""
    states, place, steps = [start], {start: 0}, []
    for state in states:
        row = []
        for approved in (False, True):
            after = next_weights(state, approved)
            if after not in place:
                place[after] = len(states)
                states.append(after)
            row.append(place[after])
        steps.append(row)
    return states, np.array(steps, dtype=np.int32).T


class _Effect:
    """The function on states that a run of decisions amounts to.

    States that meet stay together, so only distinct images are carried along.
    """

    def __init__(self, steps: np.ndarray):
        self.steps = steps
        self.images = np.arange(steps.shape[1], dtype=np.int32)
        self.where = self.images
        self.seen = 0

    def add(self, decisions: np.ndarray) -> None:
        for d in decisions:
            self.images = self.steps[int(d)][self.images]
            self.seen += 1
            if self.seen % 16 == 0:
                self.images, inverse = np.unique(self.images, return_inverse=True)
                self.where = inverse.astype(np.int32)[self.where]

    def apply(self, table: np.ndarray) -> None:
        self.images = table[self.images]

    def packed(self) -> bytes:
        return b"t" + zlib.compress(np.ascontiguousarray(self.images[self.where]).tobytes(), 1)


class _Run:
    """An effect as it grows, of decisions and of effects: a list of decisions until its table is shorter."""

    def __init__(self, steps: np.ndarray):
        self.steps, self.listed, self.n, self.effect = steps, [], 0, None

    def add(self, decisions: np.ndarray) -> None:
        if self.effect is None:
            self.listed.append(np.asarray(decisions, bool))
            self.n += len(decisions)
            if self.n < LISTED:
                return
            self._tabled()
        else:
            self.effect.add(decisions)

    def then(self, packed: bytes) -> None:
        if packed[:1] == b"d":
            self.add(_listed(packed))
        else:
            self._tabled()
            self.effect.apply(_table(packed))

    def _tabled(self) -> None:
        if self.effect is None:
            self.effect = _Effect(self.steps)
            for part in self.listed:
                self.effect.add(part)
            self.listed = []

    def packed(self) -> bytes:
        if self.effect:
            return self.effect.packed()
        return b"d" + self.n.to_bytes(4, "big") + np.packbits(np.concatenate([np.zeros(0, bool), *self.listed])).tobytes()


def _listed(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8, offset=5), count=int.from_bytes(packed[1:5], "big")).astype(bool)


def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), dtype=np.int32)


def _state_after(packed: bytes, at: int, steps: list[list[int]]) -> int:
    if packed[:1] == b"t":
        return int(_table(packed)[at])
    for d in _listed(packed).tolist():
        at = steps[d][at]
    return at


def _in_order(df: DataFrame) -> DataFrame:
    """Each (tenant, piece) whole and in time order within one partition; its first row is ``_fresh``."""
    spec = Window.partitionBy("tenant", "_bucket").orderBy("ts", "ident")
    return df.withColumn("_fresh", F.row_number().over(spec) == 1)


def _piece_starts(cut: DataFrame, tenant_type: str, fan: int) -> DataFrame:
    """Starting weights of every piece of a tenant whose history was cut."""
    states, steps = reachable()

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        effect, at = None, None

        def finished() -> pd.DataFrame:
            return pd.DataFrame({"tenant": [at[0]], "node": [at[1]], "fx": [effect.packed()]})

        for pdf in batches:
            fresh = pdf["_fresh"].to_numpy()
            edges = sorted({0, *np.flatnonzero(fresh), len(pdf)})
            for lo, hi in zip(edges, edges[1:]):
                if fresh[lo]:
                    if effect:
                        yield finished()
                    effect, at = _Run(steps), (pdf["tenant"].iloc[lo], pdf["_bucket"].iloc[lo])
                effect.add(pdf["approved"].to_numpy()[lo:hi])
        if effect:
            yield finished()

    found = _in_order(cut.filter("_bucket > 0")).mapInPandas(effects, f"tenant {tenant_type}, node int, fx binary")
    found = materialise(found, "effects")
    pieces = found.agg(F.max("node").alias("n")).first()["n"]
    return _states_before(found, states, steps, pieces, fan).withColumnRenamed("node", "_bucket").drop("at")


def _states_before(level: DataFrame, states: list[tuple], steps: np.ndarray, size: int, fan: int) -> DataFrame:
    """The state before every node, where each node's effect is known.

    Up to ``fan`` neighbours are composed into one node of the level above, until one group
    per tenant is left; the states found there go down again. So no task holds more than
    ``fan`` effects, whatever the length of a history.
    """
    tenant = level.schema["tenant"].dataType.simpleString()
    rows = steps.tolist()
    # the work goes by groups and not by bytes, which are few: tasks are not merged
    tasks = 4 * level.sparkSession.sparkContext.defaultParallelism

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        run = _Run(steps)
        for packed in pdf["fx"]:
            run.then(packed)
        return pdf[["tenant"]].head(1).assign(node=int(pdf["node"].iloc[0]) // fan, fx=run.packed())

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        at, seen = int(pdf["at"].iloc[0]), []
        for packed in pdf["fx"]:
            seen.append(at)
            at = _state_after(packed, at, rows)
        weights = pd.DataFrame([states[i] for i in seen], columns=list(NAMES), index=pdf.index)
        return pd.concat([pdf[["tenant", "node"]].assign(at=seen), weights], axis=1)

    above = F.expr(f"CAST(node DIV {int(fan)} AS INT)")
    if size < fan:
        begun = level.withColumn("at", F.lit(0))
    else:
        grouped = level.withColumn("_above", above).repartition(tasks, "tenant", "_above").groupBy("tenant", "_above")
        upper = grouped.applyInPandas(composed, f"tenant {tenant}, node int, fx binary")
        known = _states_before(materialise(upper, "effects"), states, steps, size // fan, fan)
        # one row per group of nodes: fewer than the pieces, whose number the caller bounds
        known = known.select("tenant", F.col("node").alias("_above"), "at")
        begun = join_null_safe(level.withColumn("_above", above), known, ["tenant", "_above"], "inner")
    schema = f"tenant {tenant}, node int, at int, " + ", ".join(f"{n} double" for n in NAMES)
    return begun.withColumn("_above", above).repartition(tasks, "tenant", "_above").groupBy("tenant", "_above").applyInPandas(walked, schema)


def fold_weights(
    decisions: DataFrame, tenant: str, ts: str, ident: str, status: str = "status", rows: int = HOT_ROWS, fan: int = 256
) -> DataFrame:
    """Old and new weights at every approval or rejection, per tenant in time order.

    Sorted partitions stream through the fold, which remembers three numbers, so a task
    never holds a tenant's history. A tenant with more than ``rows`` decisions is cut into
    pieces: each piece's effect is computed on its own, the effects are composed ``fan`` at a
    time to give every piece its starting weights, and the pieces are replayed in parallel.
    """
    used = decisions.filter(F.col(status).isin(DECIDED)).select(
        F.col(tenant).alias("tenant"), F.col(ts).alias("ts"), F.col(ident).alias("ident"),
        (F.col(status) == "approved").alias("approved"),
    )
    cut, any_cut = with_time_bucket(used, ["tenant"], ["ts", "ident"], rows)
    if any_cut:
        # one row per piece: at most 2 * total / rows of them
        starts = _piece_starts(cut, used.schema["tenant"].dataType.simpleString(), fan)
        cut = join_null_safe(cut, starts, ["tenant", "_bucket"])
    else:
        cut = cut.withColumns({n: F.lit(None).cast("double") for n in NAMES})
    log_schema = T.StructType(
        [*used.schema.fields, *[T.StructField(f"{w}_{n}", T.DoubleType()) for w in ("old", "new") for n in NAMES]]
    )

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = {}
        at = START
        for pdf in batches:
            if pdf.empty:
                continue
            old, new = [], []
            given = zip(*(pdf[n].tolist() for n in NAMES))
            for begins, approved, start in zip(pdf["_fresh"].tolist(), pdf["approved"].tolist(), given):
                if begins:
                    at = START if pd.isna(start[0]) else start
                old.append(at)
                after = known.get((at, approved))
                if after is None:
                    after = known[(at, approved)] = next_weights(at, approved)
                new.append(after)
                at = after
            out = pdf[["tenant", "ts", "ident", "approved"]].copy()
            for prefix, walked in (("old", np.array(old)), ("new", np.array(new))):
                for j, n in enumerate(NAMES):
                    out[f"{prefix}_{n}"] = walked[:, j]
            yield out

    return _in_order(cut).mapInPandas(replay, log_schema)


def final_weights(log: DataFrame) -> DataFrame:
    """The weights each tenant ended with."""
    order = F.struct("ts", "ident")
    return log.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("decisions"),
        *[F.max_by(f"new_{n}", order).alias(n) for n in NAMES],
    )

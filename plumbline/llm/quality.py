"""Quality classifier: hashed word n-grams under logistic regression, trained by follow the regularised leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import words as W

SLOTS = 1 << 18
MAX_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.1, 1.0, 1e-4, 1e-4
THRESHOLD = 0.3

# Classes of bytes for the shape of a word: small letters and bytes beyond ASCII, capitals, digits; others are themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _shapes(found: W.Words) -> np.ndarray:
    """A hash of each word's byte classes, runs of one class taken as one."""
    data = _SHAPE[found.data]
    new = np.ones(len(data), bool)
    new[1:] = data[1:] != data[:-1]
    new[found.starts] = True
    upto = np.concatenate(([0], np.cumsum(new)))
    return W.span_hashes(data[new], upto[found.starts], upto[found.ends])


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse rows of consecutive texts: first row, offsets per row, slots and values.

    Features are words and pairs of words, by spelling and by shape, and words that repeat the one before; each
    kind of feature has values that sum to one over the text, square-rooted. An empty text has none.
    """
    for at, end, data, offsets in W.slices(texts):
        found = W.split(data, offsets)
        n = end - at
        doc = found.doc
        spelled, shaped = found.hashes(), _shapes(found)
        pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
        same = pair[spelled[pair] == spelled[pair + 1]]
        kinds = [
            (doc, spelled), (doc[pair], spelled[pair] * np.uint64(3) + W.mix(spelled[pair + 1], 1)),
            (doc, shaped), (doc[pair], shaped[pair] * np.uint64(3) + W.mix(shaped[pair + 1], 1)),
            (doc[same], np.zeros(len(same), np.uint64)),
        ]
        total = np.maximum(np.bincount(doc, minlength=n), 1).astype(np.float64)
        keys, values = [], []
        for kind, (of, hashed) in enumerate(kinds):
            slot = W.mix(hashed, 11 + kind) & np.uint64(SLOTS - 1)
            key, count = np.unique((of.astype(np.uint64) << np.uint64(20)) | slot, return_counts=True)
            keys.append(key)
            values.append(np.sqrt(count / total[(key >> np.uint64(20)).astype(np.int64)]))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        rows = (keys >> np.uint64(20)).astype(np.int64)
        yield at, np.searchsorted(rows, np.arange(n + 1)), (keys & np.uint64(SLOTS - 1)).astype(np.int64), values


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


PACKED = "order string, tie int, label int, n int, features binary"


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of labelled texts (text, label, order, tie), each row's compressed by itself."""
    for batch in batches:
        n, packed = [], []
        for _, offsets, slots, values in features(batch.column(0)):
            for a, b in zip(offsets[:-1], offsets[1:]):
                # the same slot may stand for two features of a text: its values add up
                slot, back = np.unique(np.append(slots[a:b], SLOTS), return_inverse=True)
                x = np.bincount(back, np.append(values[a:b], 1.0))
                # planes of equally significant bytes, of steps from slot to slot and of values: most are alike
                planes = [np.diff(slot, prepend=0).astype(np.int32).view(np.uint8).reshape(-1, 4).T, x.view(np.uint8).reshape(-1, 8).T]
                n.append(len(slot))
                packed.append(pa.compress(b"".join(p.tobytes() for p in planes), codec="zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(1), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], names=["order", "tie", "label", "n", "features"])


def _unpack(packed: pa.BinaryScalar, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(pa.decompress(packed.as_buffer(), 12 * n, codec="zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(data[: 4 * n].reshape(4, n).T).view(np.int32).reshape(-1)
    return np.cumsum(steps), np.ascontiguousarray(data[4 * n :].reshape(8, n).T).view(np.float64).reshape(-1)


def fit(rows: pa.Table) -> np.ndarray:
    """Weights from one online run over packed labelled texts, ``EPOCHS`` passes in the order of their hashes; the last is the bias.

    One text is unpacked at a time."""
    rows = rows.select(["order", "tie", "label", "n", "features"])
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("order", "tie", "label")]).to_pylist()
    labels, sizes, packed = rows.column("label").to_pylist(), rows.column("n").to_pylist(), rows.column("features")
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for _ in range(EPOCHS):
        for i in order:
            slots, x = _unpack(packed[i], sizes[i])
            w = _weights(z[slots], n[slots])
            g = (_sigmoid(w @ x) - labels[i]) * x
            step = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - step * w
            n[slots] += g * g
    return _weights(z, n)


def train(labelled: DataFrame, key: str, text: str, label: str, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Fit on at most about ``max_rows`` labelled rows, chosen by a hash of their key; the bound is a parameter.

    Features are found where the rows are; the fit is one task over those of that bounded sample, compressed. Only
    the weights, of fixed size, come to the driver.
    """
    rows = labelled.filter(F.col(label).isin(0, 1)).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("order"),
    )
    count = rows.count()
    if count > max_rows:
        rows = rows.filter(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") < int(2**32 * max_rows / count))
    rows = rows.withColumn("tie", F.dense_rank().over(Window.partitionBy("order").orderBy("text")))
    packed = rows.select("text", "label", "order", "tie").mapInArrow(pack_rows, PACKED)

    def run(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([fit(table).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    got = packed.withColumn("sample", F.lit(0)).groupBy("sample").applyInArrow(run, "weights binary").first()
    return np.frombuffer(got["weights"], np.float32) if got else np.zeros(SLOTS + 1, np.float32)


def score_texts(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text. No shuffle; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # SLOTS + 1 floats
    position = docs.columns.index(text)

    def run(batches):
        w = shared.value.astype(np.float64)
        for batch in batches:
            scores = np.full(batch.num_rows, _sigmoid(w[SLOTS]))
            for at, offsets, slots, values in features(batch.column(position)):
                sums = np.concatenate(([0.0], np.cumsum(w[slots] * values)))
                scores[at : at + len(offsets) - 1] = _sigmoid(w[SLOTS] + sums[offsets[1:]] - sums[offsets[:-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def held_out(key: str, fold: int) -> F.Column:
    """Whether the row's key falls into a fold of five; a null key is the empty string."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == fold


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """Score every whole text; learn from the labelled rows outside the held-out fold.

    Only the text enters a score. Adds ``held_out``, ``score`` and ``predicted`` to ``docs`` (columns of these
    names are replaced). Null and empty texts score like a text without features: the bias. Labels other than 0
    and 1, and of unknown documents, are left out; several labels of a document all count. Without labels every
    score is 0.5. Repeated rows are scored alike; an empty table gives no rows. Labels are few beside
    documents, and are broadcast only if measured small.
    """
    docs = docs.drop("held_out", "score", "predicted")
    known = labels.filter(~held_out(key, 0)).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    named = docs.filter(~held_out(key, 0)).select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    pairs = named.join(known, F.col("_id") == F.col("_key"))
    weights = train(pairs, "_id", "_text", "_label", max_rows)
    scored = score_texts(docs, weights, text)
    return scored.withColumn("held_out", held_out(key, 0)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

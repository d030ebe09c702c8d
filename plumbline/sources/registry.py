"""Manifest of uploaded files: size, SHA-256, extension, time."""

from __future__ import annotations

import _hashlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.session import scratch_path

# The largest file that fits into one binary cell, and the largest that is hashed as one if it can be cut;
# the bytes of a file that one task hashes; the longest line.
LARGEST = 2**31 - 16
WHOLE = 1 << 27
PIECE = 1 << 28
LONGEST_LINE = 1 << 26
ROW = 1 << 18  # bytes of a file in one row
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)$"  # names of files that Spark unpacks when it reads lines
MARK = b"\xef\xbb\xbf"  # left out by the reader of lines at the start of a file


# SHA-256 by the OpenSSL library that hashlib uses: what it keeps of a hash under way is plain bytes, which another task can go on from.
STATE_BYTES = 112


def _openssl() -> ctypes.CDLL:
    return ctypes.CDLL(_hashlib.__file__)


def _begin() -> bytes:
    state = ctypes.create_string_buffer(STATE_BYTES)
    _openssl().SHA256_Init(state)
    return state.raw


def _go_on(state: bytes, data: bytes) -> bytes:
    state = ctypes.create_string_buffer(state, STATE_BYTES)
    _openssl().SHA256_Update(state, data, ctypes.c_size_t(len(data)))
    return state.raw


def _end(state: bytes) -> str:
    digest = ctypes.create_string_buffer(32)
    _openssl().SHA256_Final(digest, ctypes.create_string_buffer(state, STATE_BYTES))
    return digest.raw.hex()


def _blocks(lines: DataFrame) -> DataFrame:
    """Files read as ``lines`` (line, at, block) as their bytes: ``data`` of file ``at``, in order of ``block`` (where in the
    file it starts) and ``n``. Each line has its end; so has the last of a file, whether or not the file has it."""

    def join(batches):
        last, n = None, 0
        for batch in batches:
            block = batch.column(2).to_numpy()
            name = batch.column(1).dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (name[1:] != name[:-1])])
            for a, b in zip(starts, [*starts[1:], len(block)]):
                here = batch.column(1)[a].as_py(), int(block[a])
                n = n if here == last else 0
                last = here
                data = b"\n".join([*batch.column(0).slice(a, b - a).to_pylist(), b""])
                for from_ in range(0, len(data), ROW):
                    row = [here[0]], [here[1]], [n], [data[from_ : from_ + ROW]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["at", "block", "n", "data"])
                    n += 1

    return lines.mapInArrow(join, "at string, block long, n long, data binary")


def hash_in_pieces(spark: SparkSession, folder: str, glob: str, sizes: dict[str, int]) -> dict[str, str]:
    """SHA-256 of the files named in ``sizes``, by name. They are read in blocks, in parallel; then, round by round, a task takes
    the next ``PIECE`` bytes of one file and goes on from the state that the round before left. Files with a line over
    ``LONGEST_LINE`` are left out."""
    lines = (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("lineSep", "\n")
        .option("mapreduce.input.linerecordreader.line.maxlength", LONGEST_LINE).text(folder)
        .select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("block"))
        .filter(F.col("at").isin(list(sizes)))
    )
    path = scratch_path(spark, "file-blocks")
    _blocks(lines).write.option("parquet.block.size", 1 << 24).parquet(path)  # a task holds a group of rows at a time
    blocks = spark.read.schema("at string, block long, n long, data binary").parquet(path)
    read = dict(blocks.groupBy("at").agg(F.sum(F.octet_length("data"))).collect())
    states = {}  # of each file: the hash, and how many bytes are to come; a handful of bytes for each large file
    for at, size in sizes.items():
        lead = {0: b"", 1: b"", -len(MARK): MARK, 1 - len(MARK): MARK}.get(read.get(at, 0) - size)
        if lead is not None:
            states[at] = _go_on(_begin(), lead), size - len(lead)
    for begin in range(0, max(sizes.values()), PIECE):
        asked = {at: i for i, at in enumerate(a for a in states if sizes[a] > begin)}
        if not asked:
            break

        def go_on(batches, known={a: states[a] for a in asked}):
            now = {}
            for batch in batches:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    state, left = now.get(at) or known[at]
                    data = data.as_py()[:left]
                    now[at] = _go_on(state, data), left - len(data)
            rows = [*now], [state for state, _ in now.values()], [left for _, left in now.values()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.string(), pa.binary(), pa.int64()))], names=["at", "state", "left"])

        number = spark.createDataFrame(list(asked.items()), "at string, file int")
        piece = blocks.filter((F.col("block") >= begin) & (F.col("block") < begin + PIECE)).join(F.broadcast(number), "at")
        dealt = piece.repartitionById(len(asked), F.col("file")).sortWithinPartitions("block", "n").select("at", "data")
        for r in dealt.mapInArrow(go_on, "at string, state binary, left long").collect():
            states[r["at"]] = bytes(r["state"]), r["left"]
    return {at: _end(state) for at, (state, left) in states.items() if left == 0}


def manifest(spark: SparkSession, folder: str, glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """One row per file below ``folder``. Files over ``max_bytes``, by default none, are listed without a hash and not read.

    A file of up to ``WHOLE`` bytes is hashed as one cell, a larger one in pieces. Those that cannot be cut (of a name in ``PACKED``,
    or with a line over ``LONGEST_LINE``) are hashed as one cell too; beyond ``LARGEST`` they have no hash.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    files = files.select("*", F.col("_metadata.file_path").alias("at"))
    bound = LARGEST if max_bytes is None else min(max_bytes, LARGEST)
    cut = {}
    if hasattr(_openssl(), "SHA256_Update"):
        wanted = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
        cut = dict(files.filter((F.col("length") > WHOLE) & wanted & ~F.lower("path").rlike(PACKED)).select("at", "length").collect())
    hashes = hash_in_pieces(spark, folder, glob, cut) if cut else {}

    def listed(rows: DataFrame, digest) -> DataFrame:
        name = F.element_at(F.split("path", "/"), -1)
        extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        return rows.select(
            F.regexp_replace(name, r"[^\w\-.]", "_").alias("file"),
            extension.alias("extension"),
            extension.isin(K.UPLOAD_EXTENSIONS).alias("allowed"),
            F.col("length").alias("size_bytes"),
            digest.alias("sha256"),
            F.col("modificationTime").alias("uploaded_at"),
        )

    # both conditions are pushed down to the file scan
    others = files.filter(~F.col("at").isin(list(hashes))) if hashes else files
    found = listed(others.filter(F.col("length") <= bound), F.sha2("content", 256))
    found = found.unionByName(listed(others.drop("content").filter(F.col("length") > bound), F.lit(None).cast("string")))
    if hashes:
        known = spark.createDataFrame(list(hashes.items()), "at string, sha256 string")
        found = found.unionByName(listed(files.drop("content").join(F.broadcast(known), "at"), F.col("sha256")))
    return found.withColumn("too_large", F.col("sha256").isNull())

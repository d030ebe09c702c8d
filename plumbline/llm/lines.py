"""Line dedup by an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import join_checked, partitions
from plumbline.session import materialise

SIMILARITY = Fraction(8, 10)
SLOTS = 1 << 20
BLOCK = 1 << 14
FAN_IN = 64
PAIRS_AT_ONCE = 1 << 20
LAST = np.iinfo(np.int64).max


def ranks(counts: np.ndarray) -> np.ndarray:
    """Counts in 12 bits that rise with them: those below 128 as they are, others by their leading seven bits."""
    above = np.maximum(np.frexp(np.maximum(counts, 1).astype(np.float64))[1].astype(np.int64) - 7, 0)
    return np.minimum((above << 6) + (counts >> above), (1 << 12) - 1).astype(np.uint16)


def _by_line(place: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order of words by line, rank and hash; equal ones in any order.

    One number holds a word's line, rank, as much of its hash as there is room for, and its number; such values sort
    faster than an order is found. Words that the number does not tell apart are put in order afterwards.
    """
    n = len(hashes)
    bits = n.bit_length()
    room = 64 - bits - 12 - (int(place[-1]).bit_length() if n else 0)
    if room < 8:
        return np.lexsort((hashes, (place.astype(np.int64) << 12) | count))
    keys = (((place.astype(np.uint64) << np.uint64(12)) | count) << np.uint64(room)) | (hashes >> np.uint64(64 - room))
    keys = np.sort((keys << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    order = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
    keys >>= np.uint64(bits)
    found = hashes[order]
    mixed = np.flatnonzero((keys[1:] == keys[:-1]) & (found[1:] != found[:-1]))
    if len(mixed):
        again = np.flatnonzero(np.isin(keys, keys[mixed]))
        order[again] = order[again][np.lexsort((found[again], keys[again]))]
    return order


class Lines:
    """The token sets of the lines of a slice of texts. Lines without words have none and are not listed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray | None, wanted: np.ndarray | None = None):
        found = W.split(data, offsets)
        hashes, doc = found.hashes(), found.doc
        feeds = np.flatnonzero(data == 10)
        before = np.cumsum(np.bincount(np.searchsorted(found.starts, feeds), minlength=len(hashes))[: len(hashes)])
        line = before - np.searchsorted(feeds, offsets)[doc]
        place = before + doc  # counts up by line over the slice
        if wanted is not None:  # only whole lines that hold a token of these slots
            asked = np.flatnonzero(wanted[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)])
            lines = np.zeros(int(place[-1]) + 1 if len(place) else 0, bool)
            lines[place[asked]] = True
            held = np.flatnonzero(lines[place])
            hashes, doc, line, place = hashes[held], doc[held], line[held], place[held]
        count = np.zeros(len(hashes), np.uint16) if rarity is None else rarity[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
        # rare tokens first; any order that is the same everywhere gives the same result
        order = _by_line(place, count, hashes)
        place, self.tokens, self.count = place[order], hashes[order], count[order]
        new = np.ones(len(order), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.tokens[1:] != self.tokens[:-1])
        at = np.flatnonzero(new)
        place, self.tokens, self.count = place[at], self.tokens[at], self.count[at]
        self.first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(at) else np.zeros(0, np.int64)
        word = order[at][self.first]
        self.doc, self.line = doc[word], line[word]
        self.size = np.diff(np.append(self.first, len(at)))
        self.high, self.low = (np.add.reduceat(W.mix(self.tokens, s), self.first) if len(at) else np.zeros(0, np.uint64) for s in (61, 62))

    def bitmaps(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits per set, each the parity of the tokens that fall on it."""
        bit = W.mix(self.tokens, 63)
        one = np.uint64(1) << (bit & np.uint64(63))
        left = (bit >> np.uint64(6)) & np.uint64(1) == 0
        zero = np.uint64(0)
        return np.bitwise_xor.reduceat(np.where(left, one, zero), self.first), np.bitwise_xor.reduceat(np.where(left, zero, one), self.first)


def _ceil_share(n: np.ndarray, share: Fraction) -> np.ndarray:
    return -(-n * share.numerator // share.denominator)


def token_counts(rows: DataFrame) -> np.ndarray:
    """How often each slot of token hashes occurs in all texts: a table of fixed size, added up by a tree."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        task = 0
        for batch in batches:
            if batch.num_rows:
                task = batch.column(1)[0].as_py()
            for _, _, data, offsets in W.slices(batch.column(0)):
                slot = (W.split(data, offsets).hashes() & np.uint64(SLOTS - 1)).astype(np.int64)
                np.add.at(total, slot, 1)
        for b in range(0, SLOTS, BLOCK):
            part = total[b : b + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([task // FAN_IN], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "part", "counts"])

    def add(key, table):
        total = np.zeros(BLOCK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py() // FAN_IN if len(key) > 1 else 0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "part", "counts"])

    schema = "block int, part int, counts binary"
    sums = rows.select("text", F.spark_partition_id()).mapInArrow(count, schema)
    for keys in (("block", "part"), ("block", "part"), ("block",)):
        sums = sums.groupBy(*keys).applyInArrow(add, schema)
    out = np.zeros(SLOTS, np.int64)
    for r in sums.collect():  # SLOTS counts
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
    return out


# What a prefix token brings along, and the type of each.
ENTRY = {"token": np.uint32, "name": np.uint64, "size": np.int32, "place": np.int32, "bits0": np.uint64, "bits1": np.uint64, "id": np.int64, "line": np.int32}


def _pack(columns: dict, rows: slice) -> bytes:
    """Entries as compressed planes of equally significant bytes: most high bytes are equal, so they cost little."""
    planes = [columns[c][rows].view(np.uint8).reshape(-1, np.dtype(t).itemsize).T.tobytes() for c, t in ENTRY.items()]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> dict:
    width = sum(np.dtype(t).itemsize for t in ENTRY.values())
    data = np.frombuffer(pa.decompress(packed, n * width, codec="zstd", asbytes=True), np.uint8)
    out, at = {}, 0
    for c, t in ENTRY.items():
        end = at + n * np.dtype(t).itemsize
        out[c] = np.ascontiguousarray(data[at:end].reshape(-1, n).T).view(t).reshape(-1)
        at = end
    return out


def _prefix_entries(rows: DataFrame, rarity, buckets: int, similarity: Fraction, wanted=None) -> DataFrame:
    """The rarest tokens of each distinct line, dealt by token; with ``wanted`` only tokens of those slots."""
    def emit(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
            for at, _, data, offsets in W.slices(batch.column(1)):
                lines = Lines(data, offsets, rarity.value, None if wanted is None else wanted.value)
                if not len(lines.first):
                    continue
                bits0, bits1 = lines.bitmaps()
                owner = ids[at + lines.doc]
                # of equal sets in this slice, the first line speaks for all
                order = np.lexsort((lines.line, owner, lines.low, lines.high))
                new = np.ones(len(order), bool)
                new[1:] = (lines.high[order][1:] != lines.high[order][:-1]) | (lines.low[order][1:] != lines.low[order][:-1])
                own = np.zeros(len(order), bool)
                own[order[new]] = True
                length = np.where(own, lines.size - _ceil_share(lines.size, similarity) + 1, 0)
                of = np.repeat(np.arange(len(length)), length)
                place = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
                spot = lines.first[of] + place
                token = lines.tokens[spot]
                # a token that stands once in all texts leads to no other line
                keep = lines.count[spot] > 1
                if wanted is not None:
                    keep &= wanted.value[(token & np.uint64(SLOTS - 1)).astype(np.int64)]
                token, of, place = token[keep], of[keep], place[keep]
                bucket = (token % np.uint64(buckets)).astype(np.int64)
                columns = {
                    "token": token >> np.uint64(32), "name": lines.high[of], "size": lines.size[of], "place": place,
                    "bits0": bits0[of], "bits1": bits1[of], "id": owner[of], "line": lines.line[of],
                }
                order = np.argsort(bucket, kind="stable")
                names, cuts = np.unique(bucket[order], return_index=True)
                cuts = np.append(cuts, len(order))
                packed = {c: v.astype(ENTRY[c])[order] for c, v in columns.items()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array([_pack(packed, slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                    names=["bucket", "n", "entries"],
                )

    return rows.select("id", "text").mapInArrow(emit, "bucket int, n int, entries binary")


CANDIDATE = "name long, id long, line int, name2 long, id2 long, line2 int, apart int, more long"


def _pair_blocks(e: dict, similarity: Fraction):
    """Pairs of entries with one token that pass the length, positional and bitmap filters, in blocks."""
    key = (e["token"].astype(np.int64) << 31) | e["size"]
    n = len(key)
    longest = (e["token"].astype(np.int64) << 31) | np.minimum(e["size"].astype(np.int64) * similarity.denominator // similarity.numerator, (1 << 31) - 1)
    end = np.searchsorted(key, longest, "right")
    todo = end - np.arange(n) - 1
    upto = np.cumsum(todo)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        x = np.repeat(np.arange(at, stop), todo[at:stop])
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[at:stop] - todo[at:stop] - (upto[at - 1] if at else 0), todo[at:stop])
        at = stop
        both = e["size"][x].astype(np.int64) + e["size"][y]
        need = _ceil_share(both, similarity / (1 + similarity))
        room = 1 + np.minimum(e["size"][x] - e["place"][x], e["size"][y] - e["place"][y]) - 1
        apart = (np.bitwise_count(e["bits0"][x] ^ e["bits0"][y]) + np.bitwise_count(e["bits1"][x] ^ e["bits1"][y])).astype(np.int64)
        good = (room >= need) & (apart <= both - 2 * need) & (e["name"][x] != e["name"][y])
        x, y, apart = x[good], y[good], apart[good]
        later = (e["id"][x] > e["id"][y]) | ((e["id"][x] == e["id"][y]) & (e["line"][x] > e["line"][y]))
        yield np.where(later, x, y), np.where(later, y, x), apart


def _candidates(entries: DataFrame, similarity: Fraction, probes=None) -> DataFrame:
    """For each later line the candidate whose bitmap is nearest, per token; with ``probes`` all their candidates."""

    def match(key, table):
        chunks = [_unpack(x.as_py(), n.as_py()) for n, x in zip(table.column("n"), table.column("entries"))]
        e = {c: np.concatenate([x[c] for x in chunks]) for c in ENTRY}
        del chunks
        order = np.lexsort((e["line"], e["id"], e["name"], e["size"], e["token"]))
        e = {c: v[order] for c, v in e.items()}
        new = np.ones(len(order), bool)  # a set's entries for one token: the earliest line stays
        new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["name"][1:] != e["name"][:-1]) | (e["size"][1:] != e["size"][:-1])
        e = {c: v[new] for c, v in e.items()}
        n = len(e["token"])
        nearest, best, more = np.full(n, 1 << 30), np.full(n, -1), np.zeros(n, np.int64)
        pairs = []
        for later, earlier, apart in _pair_blocks(e, similarity):
            if probes is not None:
                keep = probes.value[(e["name"][later] & np.uint64(SLOTS - 1)).astype(np.int64)]
                pairs.append((later[keep], earlier[keep], apart[keep]))
                continue
            np.add.at(more, later, 1)
            np.minimum.at(nearest, later, apart)
            at = np.flatnonzero(apart == nearest[later])
            best[later[at]] = earlier[at]
        if probes is None:
            later = np.flatnonzero(best >= 0)
            pairs = [(later, best[later], nearest[later])]
        later, earlier, apart = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        side = lambda i: [pa.array(e["name"][i].view(np.int64)), pa.array(e["id"][i]), pa.array(e["line"][i])]
        return pa.table([*side(later), *side(earlier), pa.array(apart, pa.int32()), pa.array(more[later])], names=[c.split()[0] for c in CANDIDATE.split(", ")])

    return entries.groupBy("bucket").applyInArrow(match, CANDIDATE)


def _token_sets(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The token sets of the lines in ``pairs``, from their documents."""
    ends = pairs.select("id", "line", "name").unionByName(pairs.select(F.col("id2").alias("id"), F.col("line2").alias("line"), F.col("name2").alias("name")))
    lists = ends.distinct().groupBy("id").agg(F.collect_list(F.struct("line", "name")).alias("lines"))
    lists = materialise(lists, "lines-wanted").withColumnRenamed("id", "_id")
    held = rows.select(F.coalesce("id", F.lit(LAST)).alias("id"), "text")
    wanted = join_checked(held, lists, F.col("id") == F.col("_id"), "inner").select("id", "text", "lines")

    def emit(batches):
        for batch in batches:
            asked = batch.column(2)
            for at, end, data, offsets in W.slices(batch.column(1)):
                lines = Lines(data, offsets, None)
                lo = np.searchsorted(lines.doc, np.arange(end - at + 1))
                ids, places, names, sets = [], [], [], []
                for i in range(end - at):
                    row = {(int(lines.line[j]), int(lines.high[j].view(np.int64))): j for j in range(lo[i], lo[i + 1])}
                    for want in asked[at + i].as_py():
                        j = row.get((want["line"], want["name"]))
                        if j is not None:
                            a = lines.first[j]
                            ids.append(batch.column(0)[at + i].as_py())
                            places.append(want["line"])
                            names.append(want["name"])
                            sets.append(lines.tokens[a : a + lines.size[j]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["id", "line", "name", "tokens"])

    # lines that equal in key, place and set are one
    found = wanted.mapInArrow(emit, "id long, line int, name long, tokens binary")
    return found.groupBy("name").agg(F.first("tokens").alias("tokens"))


def _verified(rows: DataFrame, pairs: DataFrame, similarity: Fraction) -> DataFrame:
    """The names of later lines in ``pairs`` whose earlier line is similar enough."""
    # already dealt by name, for both joins
    sets = _token_sets(rows, pairs)
    one = sets.select("name", F.col("tokens").alias("x"))
    two = sets.select(F.col("name").alias("name2"), F.col("tokens").alias("y"))
    both = pairs.select("name", "name2").join(one, "name").join(two, "name2").select("name", "x", "y")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(1), batch.column(2)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * similarity.denominator >= similarity.numerator * (len(x) + len(y) - common))
            yield batch.select(["name"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "name long")


def similar_lines(rows: DataFrame, similarity: Fraction) -> DataFrame:
    """Names of the distinct lines of ``rows`` (id, text) that resemble an earlier one without being equal to it.

    Each line first names its nearest candidate by bitmap, which is verified; only lines that it fails, and that
    have other candidates, then get all of those verified.
    """
    spark = rows.sparkSession
    rarity = token_counts(rows)
    shared = spark.sparkContext.broadcast(ranks(rarity))  # SLOTS ranks
    buckets = 2 * partitions(spark)
    found = _candidates(_prefix_entries(rows, shared, buckets, similarity), similarity)
    nearest = F.min_by(F.struct("id", "line", "name2", "id2", "line2"), F.struct("apart", "id2", "line2", "name2"))
    first = found.groupBy("name").agg(nearest.alias("s"), F.max("more").alias("more"), F.count_distinct("name2").alias("others"))
    first = materialise(first.select("name", "s.*", "more", "others"), "line-candidates")
    near = materialise(_verified(rows, first, similarity).distinct(), "near-lines")
    rest = first.filter("more > 1 or others > 1").join(near, "name", "left_anti")
    rest = materialise(rest, "lines-left")
    if rest.isEmpty():
        return near
    # slots of the prefix tokens and names of what is left: supersets of fixed size
    tokens = _token_sets(rows, rest.select("name", "id", "line", F.col("name").alias("name2"), F.col("id").alias("id2"), F.col("line").alias("line2")))

    def prefix(tokens):
        found = np.frombuffer(tokens, np.uint64)
        order = np.lexsort((found, shared.value[(found & np.uint64(SLOTS - 1)).astype(np.int64)]))
        return found[order[: len(found) - _ceil_share(len(found), similarity) + 1]]

    def slots(batches):
        for batch in batches:
            rare = [prefix(x) for x in batch.column(1).to_pylist()] or [np.zeros(0, np.uint64)]
            for kind, values in ((0, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), (1, np.concatenate(rare))):
                slot = np.unique((values & np.uint64(SLOTS - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), kind, np.int32)), pa.array(slot)], names=["kind", "slot"])

    flags = np.zeros((2, SLOTS), bool)
    for r in tokens.mapInArrow(slots, "kind int, slot int").distinct().collect():  # at most 2 * SLOTS
        flags[r["kind"], r["slot"]] = True
    probes, wanted = spark.sparkContext.broadcast(flags[0]), spark.sparkContext.broadcast(flags[1])
    more = _candidates(_prefix_entries(rows, shared, buckets, similarity, wanted), similarity, probes)
    more = more.join(rest.select("name"), "name", "left_semi").dropDuplicates(["name", "name2"])
    more = materialise(more, "line-candidates")
    return near.unionByName(_verified(rows, more, similarity)).distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: Fraction = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that repeat an earlier line or resemble it by a Jaccard similarity of ``similarity``.

    A line is the set of its words; order, repeats and blanks do not matter. Lines are ordered by key and place. A
    line goes if any earlier line of the input, kept or not, has an equal or similar enough set. Tokens are ordered
    by how rare they are in all texts; two similar lines share one of their rarest tokens, and pairs that do are
    held against bounds by length, place and a 128-bit parity bitmap, none of which drops a similar pair, before
    their sets are compared. Equal lines are one entry per slice of texts and one set throughout.

    Returns the columns of ``docs`` with the kept lines in ``text``, joined by line feeds, and ``n_lines`` and
    ``n_removed`` (columns of these names are replaced). Lines without words always stay. A null text stays null
    with no lines. Further columns may have any name. A null key comes last. Rows with the same key and text are one document for this purpose: their
    lines do not remove each other's. An empty table gives no rows. ``key`` is an integer.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    docs = docs.toDF(*[c if c in (key, text) else f"column{i}" for i, c in enumerate(names)])
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    near = similar_lines(rows, similarity)

    def list_lines(batches):
        for batch in batches:
            for at, _, data, offsets in W.slices(batch.column(1)):
                lines = Lines(data, offsets, None)
                of = pa.array(at + lines.doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(2).take(of), pa.array(lines.line, pa.int32()), pa.array(lines.high.view(np.int64)), pa.array(lines.low.view(np.int64))],
                    names=["id", "row", "line", "name", "low"],
                )

    keyed = rows.select(F.coalesce("id", F.lit(LAST)).alias("id"), "text", F.xxhash64("text").alias("row"))
    places = materialise(keyed.mapInArrow(list_lines, "id long, row long, line int, name long, low long"), "lines")
    spot = F.struct("id", "line", "row")
    # counted first, so that the places of sets that occur once are not shuffled
    sets = places.groupBy("name", "low").agg(F.count(F.lit(1)).alias("c"))
    sets = sets.join(near.withColumn("near", F.lit(True)), "name", "left").filter("near or c > 1")
    sets = materialise(sets.select("name", "low", F.coalesce("near", F.lit(False)).alias("near")), "line-sets-told")
    firsts = join_checked(places, sets, ["name", "low"], "inner").groupBy("name", "low", "near").agg(F.min(spot).alias("first"))
    told = materialise(firsts, "line-sets-first")
    gone = join_checked(places, told, ["name", "low"], "inner").filter(F.col("near") | (spot != F.col("first")))
    gone = gone.groupBy("id", "row").agg(F.collect_set("line").alias("_gone"))
    gone = materialise(gone, "lines-gone").select(F.col("id").alias("_id"), F.col("row").alias("_row"), "_gone")
    on = (F.coalesce(F.col(key).cast("long"), F.lit(LAST)) == F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_row"))
    joined = join_checked(docs, gone, on, "left")

    @F.arrow_udf("string")
    def left(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for whole, lost in zip(texts, gone):
            if lost.is_valid:
                lost = set(lost.as_py())
                out.append("\n".join([x for i, x in enumerate(whole.as_py().split("\n")) if i not in lost]))
            else:
                out.append(None)
        return pa.array(out, pa.string())

    # only texts that lose lines go through Python
    cut = left(F.when(F.col("_gone").isNotNull(), F.col(text)), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(cut)
    n_lines = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    counted = joined.withColumn("n_lines", F.coalesce(n_lines, F.lit(0)).cast("long"))
    counted = counted.withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    return counted.withColumn(text, kept).drop("_id", "_row", "_gone").toDF(*names, "n_lines", "n_removed")

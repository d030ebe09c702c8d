"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised by the model, cut into segments over which no piece can reach, and each distinct segment
is merged once: an agenda holds the adjacent symbol pairs that form a piece, and the best score, the leftmost of
equals, is taken until none is left. What is no piece falls back to its bytes. Short segments are merged side by
side, a round taking the head of each one's agenda; a long one has a heap of its own.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.words import SLICE_BYTES

# Segments that a Python worker remembers with their ids; all are forgotten when there are more.
REMEMBERED = 400_000
# Longer segments are merged each time and not remembered.
REMEMBERED_BYTES = 256
# Up to so many symbols a segment is merged side by side with others, beyond by a heap.
SHORT = 48
SPACE = "▁"
NEVER = np.int64(1) << np.int64(62)
IDS = np.dtype("<u4")


class Pieces:
    """A merge-type vocabulary and its agenda."""

    def __init__(self, model: bytes, checked: bool = False):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(sp.vocab_size())
        if any(sp.is_unused(i) or (sp.id_to_piece(i) in ("\t", "\n", " ")) for i in every):
            raise ValueError("vocabularies with unused or white-space pieces are not supported")
        special = {i for i in every if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in every if i not in special}
        self.scores = {p: -sp.get_score(i) for p, i in self.ids.items()}
        found = {sp.id_to_piece(i): i for i in every if sp.is_byte(i)}
        self.bytes = [found.get(f"<0x{b:02X}>") for b in range(256)] if found else None
        self.unknown = sp.unk_id()
        # a space mark inside a piece would let it reach over the start of a word
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.single = {p: i for p, i in self.ids.items() if len(p) == 1}
        self._pair_table()
        # neighbouring ASCII characters that stand side by side in no piece can never be merged
        joint = np.ones((256, 256), bool)
        joint[:128, :128] = False
        for piece in self.ids:
            raw = piece.encode()
            for x, y in zip(raw, raw[1:]):
                joint[x, y] = True
        self.apart = ~joint.ravel()
        self.checked = checked
        self.known: dict[bytes, bytes] = {}

    def _pair_table(self) -> None:
        """Sorted keys of the symbol pairs that form a piece, with its id and its place in the order of scores."""
        order = sorted(self.scores.values())
        place = {s: i for i, s in enumerate(dict.fromkeys(order))}
        n = self.library.vocab_size()
        rows = []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    rows.append((left * n + right, i, place[self.scores[piece]]))
        rows.sort()
        table = np.array(rows or [(-1, 0, 0)], np.int64)
        self.pairs, self.formed, self.place = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order of scores and id of the piece that each pair forms, or NEVER."""
        key = np.where((left < 0) | (right < 0), -2, left * self.library.vocab_size() + right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = self.pairs[at] == key
        return np.where(found, self.place[at], NEVER), self.formed[at]

    def merge_short(self, segments: list[str]) -> list[list[int]]:
        """The same as ``merge`` for many short segments: each round merges the best pair of each."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        each, back = np.unique(chars, return_inverse=True)
        # a character that is no piece is known by its negative code
        ids = np.array([self.single.get(chr(c), -1 - int(c)) for c in each], np.int64)
        symbols, owner = ids[back], np.repeat(np.arange(len(segments)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, piece = self._agenda(symbols[:-1], symbols[1:])
        rank, piece = np.append(rank, NEVER), np.append(piece, 0)
        rank[:-1][owner[:-1] != owner[1:]] = NEVER
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            live = best < NEVER
            count = np.diff(np.append(starts, len(symbols)))
            moving = np.repeat(live, count)
            if not live.all():
                done.append((owner[~moving], symbols[~moving]))
                symbols, owner, rank, piece = symbols[moving], owner[moving], rank[moving], piece[moving]
                if not len(symbols):
                    break
                count, best = count[live], best[live]
            # the leftmost pair of the best place in each segment
            hit = np.flatnonzero(rank == np.repeat(best, count))
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
            symbols[hit] = piece[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # one symbol went from each segment before
            symbols, owner, rank, piece = symbols[keep], owner[keep], rank[keep], piece[keep]
            for i in (at[at > 0] - 1, at):
                i = i[i + 1 < len(symbols)]
                new, formed = self._agenda(symbols[i], symbols[i + 1])
                rank[i] = np.where(owner[i] == owner[i + 1], new, NEVER)
                piece[i] = formed
            rank[-1] = NEVER
        if not done:
            return [[] for _ in segments]
        owner, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        owner, symbols = owner[order], symbols[order].tolist()
        ends = np.searchsorted(owner, np.arange(len(segments) + 1)).tolist()
        out = [symbols[a:b] for a, b in zip(ends, ends[1:])]
        for i in np.unique(owner[np.array(symbols) < 0]):
            out[i] = self.fall_back(out[i])
        return out

    def fall_back(self, symbols: list[int]) -> list[int]:
        """Ids in place of negative character codes: those of their bytes, or one unknown id for neighbours."""
        out: list[int] = []
        for k, i in enumerate(symbols):
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(-1 - i).encode("utf-8", "replace"))
            elif not k or symbols[k - 1] >= 0:
                out.append(self.unknown)
        return out

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment, by an agenda of adjacent symbol pairs in the order of their scores."""
        scores, symbols = self.scores, list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((scores[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            # either symbol may have been merged since the pair was noted
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair_after = pair + symbols[k]
                if pair_after in scores:
                    heapq.heappush(agenda, (scores[pair_after], i, pair_after))
            h = before[i]
            if h >= 0:
                pair_before = symbols[h] + pair
                if pair_before in scores:
                    heapq.heappush(agenda, (scores[pair_before], h, pair_before))
        return self.fall_back([self.ids.get(s, -1 - ord(s[0])) for s in symbols if s is not None])

    def encode_segments(self, segments: list[bytes]) -> list[bytes]:
        """Packed ids of each segment."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = {s: s.decode("utf-8", "replace") for s in segments if s not in self.known}
        texts = list(fresh.values())
        short = [t for t in texts if len(t) <= SHORT]
        merged = dict(zip(short, self.merge_short(short)))
        ids = [merged[t] if t in merged else self.merge(t) for t in texts]
        if self.checked:
            self.compare(texts, ids)
        found = {s: array("I", i).tobytes() for s, i in zip(fresh, ids)}
        out = [self.known[s] if s in self.known else found[s] for s in segments]
        self.known.update((s, ids) for s, ids in found.items() if len(s) <= REMEMBERED_BYTES)
        return out

    def compare(self, segments: list[str], ids: list[list[int]]) -> None:
        """Hold newly merged segments against the library, which puts the space mark before them itself."""
        texts = [s[1:] if s.startswith(SPACE) else s for s in segments]
        same = [n == s for n, s in zip(self.library.normalize(texts), segments)]
        want = self.library.encode([t for t, ok in zip(texts, same) if ok], num_threads=1)
        got = [(s, i) for s, i, ok in zip(segments, ids, same) if ok]
        for (segment, found), wanted in zip(got, want):
            if found != wanted:
                raise AssertionError(f"the library splits {segment!r} otherwise")

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where segments start: at each text, between characters no piece holds side by side, and at each run
        of space marks if no piece can reach over it."""
        starts = np.zeros(len(data), bool)
        if self.by_word and len(data) > 2:
            mark = np.zeros(len(data) + 3, bool)
            mark[3:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            starts = mark[3:] & ~mark[:-3]
        if len(data):
            starts[1:] |= self.apart[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(starts)

    def encode(self, texts: list[str], first: bytes, last: bytes) -> list[bytes]:
        """Packed ids of whole texts, between the packed ids ``first`` and ``last``."""
        parts = [t.encode() for t in self.library.normalize(texts)]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        joined = b"".join(parts)
        data = np.frombuffer(joined, np.uint8)
        cuts = self.cuts(data, offsets)
        ends = np.append(cuts, len(data)).astype(np.int64)
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(joined)])
        coded = spans.dictionary_encode()
        packed = self.encode_segments(coded.dictionary.to_pylist())
        sizes = np.fromiter((len(p) // IDS.itemsize for p in packed), np.int64, len(packed))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ids = np.frombuffer(b"".join(packed), IDS)[np.repeat(begins[which] - upto[:-1], lengths) + np.arange(upto[-1])]
        text_at = upto[np.searchsorted(cuts, offsets)]
        return [first + ids[a:b].tobytes() + last for a, b in zip(text_at, text_at[1:])]

    def decode(self, packed: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(p, IDS).tolist() for p in packed])


_loaded: dict[int, tuple[bytes, bool, Pieces]] = {}


def loaded(model: bytes, checked: bool) -> Pieces:
    """The vocabulary of this Python worker, read once for all its tasks."""
    held = _loaded.get(0)
    if held is None or held[0] != model or held[1] != checked:
        held = _loaded[0] = (model, checked, Pieces(model, checked))
    return held[2]


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Consecutive rows of about a megabyte, one at least."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0))
    upto = np.cumsum(sizes)
    at = 0
    while at < len(column):
        base = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + SLICE_BYTES, "right")))
        yield column[at:end]
        at = end


def _with(schema: T.StructType, added: list[T.StructField]) -> T.StructType:
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + added)


def encode_texts(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    begin: bool = True,
    end: bool = True,
    decoded: bool = False,
    checked: bool = True,
) -> DataFrame:
    """Add ``ids``, the ids of each whole text as packed little-endian unsigned 32-bit integers, and ``n_tokens``.

    ``begin`` and ``end`` add the model's begin and end ids; ``decoded`` adds the text that the ids decode to.
    ``checked`` holds every newly merged segment of a batch against the library and fails where they differ.
    The model file is read by the driver and shipped (it is the vocabulary, of fixed size), so executors need no copy.

    Nothing is shuffled: each Arrow batch is handled alone, in slices of about a megabyte, at least one text. A
    null text is an empty one: begin and end ids only, decoding to an empty text. A text without spaces is one
    segment, merged in n log n steps. Rows are kept as they are, repeated ones and null keys too; an empty table
    gives none. Further columns stay, but for columns called ``ids``, ``n_tokens`` or ``decoded``, which give way.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if decoded:
        added.append(T.StructField("decoded", T.StringType()))
    schema = _with(docs.schema, added)
    kept = [f.name for f in schema.fields[: len(schema.fields) - len(added)]]
    # the text travels beside the columns kept, under a name none of them has
    name = "_text"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    source = docs.select(*(docs[f"`{c}`"] for c in kept), docs[f"`{text}`"].alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value, checked)
        edge = lambda on, i: np.array([i] if on and i >= 0 else [], IDS).tobytes()
        first, last = edge(begin, pieces.library.bos_id()), edge(end, pieces.library.eos_id())
        for batch in batches:
            at = 0
            for column in _slices(batch.column(len(kept))):
                texts = [t or "" for t in column.to_pylist()]
                packed = pieces.encode(texts, first, last)
                out = [batch.column(i).slice(at, len(texts)) for i in range(len(kept))]
                out += [pa.array(packed, pa.binary()), pa.array([len(p) // IDS.itemsize for p in packed], pa.int64())]
                if decoded:
                    out.append(pa.array(pieces.decode(packed), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])
                at += len(texts)

    return source.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of packed ids as ``encode_texts`` writes them. Null ids decode to an empty text."""
    with open(model_path, "rb") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())
    schema = _with(encoded.schema, [T.StructField("decoded", T.StringType())])
    kept = [f.name for f in schema.fields[:-1]]
    source = encoded.select(*(encoded[f"`{c}`"] for c in kept), encoded[f"`{ids}`"].alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value, False)
        for batch in batches:
            at = 0
            for column in _slices(batch.column(len(kept))):
                texts = pieces.decode([p or b"" for p in column.to_pylist()])
                out = [batch.column(i).slice(at, len(texts)) for i in range(len(kept))] + [pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])
                at += len(texts)

    return source.mapInArrow(run, schema)

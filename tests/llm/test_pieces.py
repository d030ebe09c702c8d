"""Encoding by the agenda against the sentencepiece library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plumbline.llm import pieces
from plumbline.llm.queries import op11_piece_ids

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "   ", "a", "Hello world.", "  two  blanks ", "tab\tnew\nline\r\n\r\n", "▁ mark ▁▁x", "<s>not</s> <unk> <0x0A>", "é́ ü ñ",
    "日本語のテキスト", "emoji 😀👩‍👩‍👧 end", "\x00nul\x01", "a b﻿c ", "x" * 5000, "ab" * 3000 + " " + "word " * 500, "...!!!???", "aaaaaaaaaaaaaaaaaaaa bbbb",
    "1234567890 12,345.67", "\n\n\n\n", "end ", "ſtraße İstanbul", "  for i in range(10):\n\tprint(i)\n",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return np.array(ids, "<u4").tobytes(), len(ids), library.decode(ids)


def test_texts_as_the_library(spark, library):
    rng = random.Random(5)
    alphabet = "abcdeth nor  .,\n'\"-éßжд中😀▁0123<>"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 400))) for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in pieces.encode_texts(df, MODEL, decoded=True).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert (bytes(got[i].ids), got[i].n_tokens, got[i].decoded) == expected(library, text), repr(text)


def test_long_segment_by_heap_and_side_by_side_agree():
    with open(MODEL, "rb") as file:
        vocabulary = pieces.Pieces(file.read())
    rng = random.Random(7)
    segments = ["▁" + "".join(rng.choices("aehinorst中\x00", k=rng.randint(1, 47))) for _ in range(500)]
    assert vocabulary.merge_short(segments) == [vocabulary.merge(s) for s in segments]
    assert vocabulary.merge_short([]) == []


def test_columns_nulls_and_repeats(spark, library):
    rows = [(None, "same text", 1, "x"), (None, "same text", 1, "x"), (3, None, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, _text string")
    out = pieces.encode_texts(df, MODEL, begin=False)
    assert out.columns == ["doc_id", "text", "_text", "ids", "n_tokens"]
    got = sorted((r.doc_id or 0, r._text, bytes(r.ids)) for r in out.collect())
    one = np.array(library.encode("same text", add_eos=True), "<u4").tobytes()
    assert got == [(0, "x", one), (0, "x", one), (3, None, np.array([2], "<u4").tobytes())]
    back = pieces.decode_ids(out, MODEL).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in back)
    assert pieces.encode_texts(df.limit(0), MODEL, decoded=True).count() == 0


def test_a_difference_from_the_library_fails():
    with open(MODEL, "rb") as file:
        vocabulary = pieces.Pieces(file.read(), checked=True)
    with pytest.raises(AssertionError):
        vocabulary.compare(["▁word"], [[1, 2, 3]])


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op11_piece_ids(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, n, text = expected(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_round_trip(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    assert pieces.encode_texts(df, MODEL, decoded=True).filter("decoded <> text").count() == 0

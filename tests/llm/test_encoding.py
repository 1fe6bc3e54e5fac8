import os
import random
import time

import pytest

from relayscope.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.DEFAULT_VOCABULARY), reason="no vocabulary here")

TEXTS = [None, "", " ", "Hello, world!  It's\r\n\tfine", "Straße 12345 é é 日本語 😀👨‍👩‍👧", "<|endoftext|>", "a" * 2000, "ab" * 500, "=-" * 400, "\x00\x1f\x85  x", "　\xa0  y ", "x" * 7 + "\n" * 50, "0123456789" * 100]


def test_same_ids_as_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(encoding.DEFAULT_VOCABULARY)
    library.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], [1])], "k long, t string, ids array<int>")
    rows = encoding.encode(df, "k", "t").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert r["ids"] == (library.encode(TEXTS[r["k"]], add_special_tokens=False).ids if TEXTS[r["k"]] else [])


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize(("alphabet", "size"), [("a", 5001), ("ab", 4000), ("=-_*", 6000), ("aé漢😀", 3000), ("etaoin", 20_000), (LETTERS, 60_000)])
def test_long_words_take_few_rounds(alphabet, size):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(encoding.DEFAULT_VOCABULARY)
    word = "".join(random.Random(size).choices(alphabet, k=size))
    began = time.process_time()
    got = encoding.WordEncoder(encoding.Vocabulary(encoding.DEFAULT_VOCABULARY)).encode([word, "", None, word])
    assert time.process_time() - began < 30
    assert got == [library.encode(word, add_special_tokens=False).ids, [], [], got[0]]


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string")
    got = {r["k"]: r["text"] for r in encoding.decode(encoding.encode(df, "k", "t"), "k", "ids").collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_whole_table_against_the_library(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(encoding.DEFAULT_VOCABULARY)
    library.encode_special_tokens = True
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in encoding.encode(docs, "doc_id", "text").collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids


def test_empty_table(spark):
    assert encoding.encode(spark.createDataFrame([], "k long, t string"), "k", "t").count() == 0

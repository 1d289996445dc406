import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from docsheaf.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGES = ["", " ", "   ", "a  b   ", "\n\n", "x\n\n\ny", "\x1c's", "　x", "z" * 3000, "ab" * 500, "😀 don't\r\n", "<|endoftext|>", "漢字" * 200]


@pytest.fixture(scope="module")
def library():
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    return encoding.encode_ordinary


def test_words_agree_with_the_library(library):
    rng = random.Random(5)
    letters = "aaabetionrsßéñ漢 🙂.,'9\n\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + EDGES
    words = bpe.vocabulary(PATH)
    ids, counts = words.coder.encode(pa.array(texts))
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [library(t) for t in texts]
    assert [b.decode() for b in words.decode(ids, counts)] == texts


def test_heap_and_recursive_query_agree():
    rng = random.Random(7)
    words = ["".join(rng.choice("aaeentiorsß") for _ in range(rng.randint(1, 60))).encode() for _ in range(300)]
    v = bpe.vocabulary(PATH)
    assert v.contract(words) == [v.contract_long(w) for w in words]


def test_query(spark, sf_dir, library):
    expected = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.query(spark, sf_dir).collect()
    assert len(rows) == len(expected)
    for r in rows:
        ids = library(expected[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(expected[r["doc_id"]].encode()).hexdigest()


def test_nulls_and_runs(spark, monkeypatch):
    rows = [(1, None, "x"), (None, "abc def", "y"), (1, None, "x"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"] or 0, len(r["ids"]), bytes(r["decoded"])) for r in bpe.round_trip(docs, PATH).collect())
    assert got[1:] == [(1, 0, b""), (1, 0, b""), (2, 0, b"")] and got[0][2] == b"abc def"
    coded = bpe.encode(docs, PATH)
    assert {bytes(r["decoded"]) for r in bpe.decode(coded, PATH).collect()} == {b"", b"abc def"}
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    v = bpe.vocabulary(PATH)
    monkeypatch.setattr(bpe, "TOKENS_AT_ONCE", 3)
    texts = ["one two three four five six", "", "seven", "a b c"]
    ids, counts = v.coder.encode(pa.array(texts))
    assert [b.decode() for b in v.decode(ids, counts)] == texts

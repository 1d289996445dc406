import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docsheaf.llm import packing, tokenfile, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [None, "", " ", "   ", "a", "a  b   ", "\n\n", "x\n\n\ny", "\t\n", "<|endoftext|>", "\x1c's", "　x", "z" * 5000, "😀 don't\r\n", " lead", "trail "]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def documents(spark, sf_dir):
    extra = [(10_000 + k, t, k, "clash") for k, t in enumerate([*EDGES, *EDGES[:4]])]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.selectExpr("doc_id", "text", "0L as n", "'' as file").unionByName(spark.createDataFrame(extra, "doc_id long, text string, n long, file string"))


def test_ids_agree_with_the_library(library):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "a", "é", "Z", "9", ".", "'s", "don't", "漢", "🙂", "\r\n", " x", "\x00", "ª", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + EDGES
    got = [x.tolist() for x in tokens.vocabulary_coder(VOCABULARY).encode(pa.array(texts, pa.string()))]
    assert got == library(texts)


def test_runs_of_spaces_that_the_rank_encoder_refuses():
    loaded = Tokenizer.from_file(VOCABULARY)
    for text in (" " * 1_100_000 + "x", "a<|endoftext|>" + "\n" * 1_100_000):
        assert tokens.vocabulary_coder(VOCABULARY, added=True).encode_one(text).tolist() == loaded.encode(text, add_special_tokens=False).ids


def test_queries_take_added_tokens_as_the_library_does(spark, tmp_path):
    loaded = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|", "endoftext", "|>", " ", "  ", "\n", "a", " b", "'s", "\u6f22", "9", ". "]
    texts = ["ab <|endoftext|> cd", "plain text", *EDGES] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(500)]
    expected = [e.ids for e in loaded.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert expected[0] == [397, 220, 50256, 22927]
    assert [x.tolist() for x in tokens.vocabulary_coder(VOCABULARY, added=True).encode(pa.array(texts, pa.string()))] == expected
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    at = 0
    written = {r["doc_id"]: r for r in tokenfile.query(spark, f"file://{tmp_path}").collect()}
    packed = {r["doc_id"]: r["doc_tokens"] for r in packing.query(spark, f"file://{tmp_path}").collect()}
    for doc, own in enumerate(expected):
        r = written[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own) + 1, zlib.crc32(np.array([*own, 2], dtype="<u4").tobytes()))
        assert packed[doc] == len(own) + 1
        at += len(own) + 1


def test_cache_stays_bounded():
    coder = tokens.PieceCoder(str.split, lambda pieces, cache: [b"\0\0\0\0" for _ in pieces], cache_pieces=10)
    for k in range(30):
        ids, counts = coder.encode(pa.array([f"w{k} v{k}"]))
        assert counts.tolist() == [2] and len(ids) == 2
    assert len(coder.cache) <= 10


def test_packing_covers_every_id_once(spark, sf_dir, library):
    docs = documents(spark, sf_dir)
    rows = packing.pack(docs, VOCABULARY).collect()
    expected = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        part = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(part) == r["length"] > 0
        own = found.setdefault(r["doc_id"], [])
        assert len(own) == r["start"]
        own += part
    ids = dict(zip(expected, library(expected.values()), strict=True))
    assert found == {k: v + [1] for k, v in ids.items()}
    assert all(r["doc_tokens"] == len(found[r["doc_id"]]) for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(map(len, found.values()))
    assert len(by_sequence) * packing.CAPACITY - total < 8 * packing.CAPACITY


def test_plan_balances_cost():
    lengths = np.array([1500, 1200, 900, 700, 500, 300, 200, 100, 40, 0])
    pieces = packing.plan(lengths, capacity=2048)
    assert sum(p[2] for p in pieces) == lengths.sum()
    assert [p[0] for p in pieces[:2]] == [0, 1] and pieces[0][3] != pieces[1][3]
    assert packing.plan(np.array([], dtype=np.int64)) == []


def test_plans_pad_less_than_one_sequence_and_cut_few_documents():
    rng = random.Random(6)
    for _ in range(60):
        lengths = np.array([rng.choice([rng.randint(1, 60), rng.randint(1, 900), rng.randint(1, 7000)]) for _ in range(rng.randint(1, 120))])
        pieces = packing.plan(lengths, capacity=512)
        cover, used = {}, {}
        for doc, start, length, seq, offset in pieces:
            cover.setdefault(doc, []).append((start, length))
            used.setdefault(seq, []).append((offset, length))
        for doc, own in cover.items():
            assert sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False))
            assert sum(n for _, n in own) == lengths[doc]
        for own in used.values():
            assert sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False))
        assert len(used) == -(-int(lengths.sum()) // 512)
        assert len(pieces) <= len(lengths) + 2 * len(used)


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 262_144, 300_001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
    table, blocks = tokenfile.encode_segment(ids)
    assert np.array_equal(tokenfile.decode_segment(table, blocks), ids)
    blocks[0]["words"] = b"\x01\x02\x03\x04" * (len(blocks[0]["words"]) // 4 + 1)
    blocks[0]["crc"] ^= 1
    with pytest.raises(ValueError):
        tokenfile.decode_segment(table, blocks)


def test_rans_one_symbol():
    table, blocks = tokenfile.encode_segment(np.full(9000, 7, dtype=np.uint32))
    assert tokenfile.decode_segment(table, blocks).tolist() == [7] * 9000


def test_token_files(spark, sf_dir, library, tmp_path):
    docs = documents(spark, sf_dir)
    path = f"file://{tmp_path}/files"
    tokenfile.write(docs, path, VOCABULARY, segment_tokens=5_000)
    got = tokenfile.read(spark, path).join(tokenfile.segment_starts(spark, path), "segment").collect()
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    at = 0
    got = {r["doc_id"]: r for r in got}
    assert len(got) == len(texts)
    for (doc, _), ids in zip(texts, library([t for _, t in texts]), strict=True):
        r = got[doc]
        assert r["before"] + r["start"] == at and r["n_tokens"] == len(ids) + 1
        assert zlib.crc32(r["ids"]) == zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes())
        at += len(ids) + 1


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, VOCABULARY).count() == 0
    path = f"file://{tmp_path}/none"
    tokenfile.write(none, path, VOCABULARY)
    assert tokenfile.read(spark, path).count() == 0

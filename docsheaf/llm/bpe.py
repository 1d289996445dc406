"""Byte-level BPE by recursive queries.

Each worker process holds an in-memory DuckDB with two tables made from a rank file: ``vocab`` (id, bytes)
and ``merges`` (left id, right id, merged id; the merged id is the rank).  Encoding: the words of a
batch that the worker has not met become token-position rows, one per byte.  A recursive query joins
neighbouring rows with ``merges`` and contracts each word's leftmost pair of minimum rank, until no
word has a pair.  Decoding: the ids of a batch join ``vocab`` and an ordered aggregation puts their
bytes together.

Words are the matches of the vocabulary's pattern, each encoded by itself; a word that is a token is
that token.  A word of over LONG bytes would need as many rounds over as many rows, so it is
contracted with a heap instead, by the same rule.

Defined cases: a null text is encoded as an empty one, to no ids; strings that name special tokens
are ordinary text; repeated rows each get a row; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.llm import tokens
from docsheaf.llm.shared import read_documents

LONG, WORDS_AT_ONCE, TOKENS_AT_ONCE, BATCH_BYTES = 128, 20_000, 400_000, 3_000_000

#: A row's place is ``word << 8 | byte``; a pair's key is ``merged << 32 | place``, so the least key of a word
#: is its leftmost pair of minimum rank.  Words without a pair leave the recursion as done.
CONTRACT = """
WITH RECURSIVE state(place, tok, done) AS (
  SELECT place, tok, false FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT place, tok, lead(tok) OVER w AS next_tok, lead(place) OVER w AS next_place, lag(place) OVER w AS last_place
     FROM state WHERE NOT done WINDOW w AS (ORDER BY place)),
   best AS (
     SELECT place >> 8 AS word, min((merged::BIGINT << 32) | place) AS pair
     FROM pairs JOIN merges ON tok = lft AND next_tok = rgt WHERE next_place >> 8 = place >> 8 GROUP BY ALL)
   SELECT place, CASE WHEN place = (pair & 4294967295) THEN (pair >> 32)::INT ELSE tok END, word IS NULL
   FROM pairs LEFT JOIN best ON place >> 8 = word
   WHERE pair IS NULL OR last_place IS DISTINCT FROM (pair & 4294967295))
)
SELECT place >> 8 AS word, list(tok ORDER BY place) AS ids FROM state WHERE done GROUP BY ALL ORDER BY word
"""
DECODE = "SELECT run, unhex(string_agg(hex_bytes, '' ORDER BY pos)) AS bytes FROM ids JOIN vocab USING (tok) GROUP BY run ORDER BY run"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Vocabulary:
    """A rank file in DuckDB, with a coder for batches of texts."""

    def __init__(self, path: str):
        import duckdb
        import public_tokenizers

        self.ranks = read_ranks(path)
        self.split = tokens.match_finder(public_tokenizers.PATTERN)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        parts = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        merges = pa.table(dict(zip(("lft", "rgt", "merged"), (pa.array(x, pa.int32()) for x in zip(*parts, strict=True)), strict=True)))
        vocab = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex_bytes": [t.hex() for t in self.ranks]})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": os.path.join(tempfile.gettempdir(), f"duckdb-{os.getpid()}")})
        for name, table in (("merges", merges), ("vocab", vocab)):
            self.db.register("incoming", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
            self.db.unregister("incoming")
        self.coder = tokens.PieceCoder(self.split, self._encode_new, cache_pieces=500_000)

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids (32-bit little-endian) of words of at most LONG bytes, by the recursive query."""
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            letters = np.frombuffer(b"".join(part), dtype=np.uint8)
            first = np.cumsum(sizes) - sizes
            start = pa.table({"place": np.repeat(np.arange(len(part)) << 8, sizes) + np.arange(len(letters)) - np.repeat(first, sizes), "tok": self.byte_ids[letters]})
            self.db.register("start", start)
            lists = self.db.sql(CONTRACT).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("start")
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            flat, edges = lists.values.to_numpy().astype("<u4").tobytes(), lists.offsets.to_numpy()
            out += [flat[4 * a : 4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return out

    def contract_long(self, word: bytes) -> bytes:
        """The same contraction for a long word: a heap of pairs by (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        ends, after, before = list(range(1, len(word) + 1)), [*range(1, len(word)), -1], list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(k: int) -> None:
            nxt = after[k] if k >= 0 else -1
            if nxt >= 0 and (rank := self.ranks.get(word[k : ends[nxt]])) is not None:
                heapq.heappush(heap, (rank, k, ends[nxt]))

        for k in range(len(word) - 1):
            offer(k)
        while heap:
            rank, k, end = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] < 0 or nxt < 0 or ends[nxt] != end:
                continue
            ids[k], ids[nxt], ends[k], after[k] = rank, -1, end, after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def _encode_new(self, pieces: list[str], cache: dict[str, bytes]) -> list[bytes]:
        matches = [tokens.matches(p, self.split) for p in pieces]
        known: dict[str, bytes] = {}
        short, long = [], []
        for match in dict.fromkeys(m for own in matches for m in own):
            word = match.encode()
            if match in cache:
                known[match] = cache[match]
            elif word in self.ranks:
                known[match] = self.ranks[word].to_bytes(4, "little")
            else:
                (short if len(word) <= LONG else long).append(match)
        known.update(zip(short, self.contract([m.encode() for m in short]), strict=True))
        known.update((m, self.contract_long(m.encode())) for m in long)
        return [known[own[0]] if len(own) == 1 else b"".join([known[m] for m in own]) for own in matches]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of consecutive texts of ``counts`` ids each, by ordered aggregation of runs of bounded length."""
        runs = np.concatenate([np.zeros(0, dtype=np.int64), *[np.full(int(n) // TOKENS_AT_ONCE, TOKENS_AT_ONCE) if n % TOKENS_AT_ONCE == 0 else np.append(np.full(int(n) // TOKENS_AT_ONCE, TOKENS_AT_ONCE), n % TOKENS_AT_ONCE) for n in counts]]).astype(np.int64)
        per_text = -(-counts // TOKENS_AT_ONCE)
        ends = np.cumsum(runs)
        out: list[bytes] = []
        at = 0
        while at < len(runs):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS_AT_ONCE, side="right")))
            lo = int(ends[at - 1]) if at else 0
            part = ids[lo : int(ends[stop - 1])]
            table = pa.table({"run": np.repeat(np.arange(stop - at, dtype=np.int32), runs[at:stop]), "pos": np.arange(len(part), dtype=np.int32), "tok": part.astype(np.int32)})
            self.db.register("ids", table)
            out += self.db.sql(DECODE).to_arrow_table().column("bytes").to_pylist()
            self.db.unregister("ids")
            at = stop
        edges = np.concatenate([[0], np.cumsum(per_text)]).tolist()
        return [b"".join(out[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file; one in each worker process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))


def _coded(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for part in tokens.slices(batch, "text", BATCH_BYTES):
                ids, counts = words.coder.encode(part.column("text"))
                columns = [part.column("doc_id").combine_chunks(), _lists(ids, counts)]
                if decoded:
                    columns.append(pa.array(words.decode(ids, counts), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of documents (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_coded(path, False), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids array<int>); null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            lists = batch.column("ids")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.decode(lists.flatten().to_numpy(zero_copy_only=False), counts), pa.binary())], names=["doc_id", "decoded"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): encode, and decode of its ids, in one pass over the documents."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_coded(path, True), "doc_id long, ids array<int>, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: encodes and decodes all documents."""
    import public_tokenizers

    coded = round_trip(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(text, "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

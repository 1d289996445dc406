"""Cost-balanced packing of whole documents into fixed-length sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: what the feed-forward and the attention
layers do with it when attention does not cross documents.  Each task gathers documents into pools.
In a pool, stretches of a full sequence are cut off long documents first; what is left is taken in
descending length, each to the cheapest open sequence with enough room.  A pool opens just as many
sequences as its tokens need, so a document that fits nowhere is cut over the cheapest sequences
with any room, and at most one sequence per pool is padded noticeably.  Nothing is shuffled.

Defined cases: a null or empty text is just the end id; repeated rows are packed each; null ids are
kept; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.llm import tokens
from docsheaf.llm.shared import read_documents

CAPACITY, END_ID, POOL_TOKENS = 2048, 1, 2_000_000
#: Relative cost of a token, and of a pair of tokens of one piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"


def plan(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover documents of these lengths."""
    pieces: list[tuple[int, int, int, int, int]] = []
    full = lengths // capacity
    rest = lengths - full * capacity
    sequences = 0
    for doc in np.flatnonzero(full).tolist():
        for k in range(int(full[doc])):
            pieces.append((doc, k * capacity, capacity, sequences, 0))
            sequences += 1
    opened = -(-int(rest.sum()) // capacity)
    room, cost = np.full(opened, capacity, dtype=np.int64), np.zeros(opened)

    def put(doc: int, start: int, length: int, seq: int) -> None:
        pieces.append((doc, start, length, sequences + seq, int(capacity - room[seq])))
        room[seq] -= length
        cost[seq] += linear * length + quadratic * length * length

    for doc in np.argsort(-rest, kind="stable").tolist():
        length, start = int(rest[doc]), int(full[doc]) * capacity
        if not length:
            break
        fits = np.where(room >= length, cost, np.inf)
        best = int(fits.argmin())
        if np.isfinite(fits[best]):
            put(doc, start, length, best)
            continue
        while length:
            best = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(length, int(room[best]))
            put(doc, start, part, best)
            start, length = start + part, length - part
    return pieces


def _packed(path: str, capacity: int, end_id: int, pool_tokens: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.vocabulary_coder(path, added)
        following = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        end = np.array([end_id], dtype="<u4")
        docs: list = []
        ids: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal following
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            pieces = plan(lengths, capacity)
            for at in range(0, len(pieces), 500):
                part = pieces[at : at + 500]
                doc, start, length, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*part, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[d] for d in doc], pa.int64()),
                        pa.array(start),
                        pa.array(length),
                        pa.array(lengths[doc]),
                        pa.array(seq + following),
                        pa.array(offset),
                        pa.array(LINEAR * length + QUADRATIC * length * length),
                        pa.array([ids[d][s : s + n].tobytes() for d, s, n, _, _ in part], pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "cost", "ids"],
                )
            following += 1 + max((p[3] for p in pieces), default=-1)
            docs.clear()
            ids.clear()

        held = 0
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                own = [np.concatenate([x, end]) for x in coder.encode(part.column("text"))]
                docs += part.column("doc_id").to_pylist()
                ids += own
                held += sum(map(len, own))
                if held >= pool_tokens:
                    yield from flush()
                    held = 0
        if docs:
            yield from flush()

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS, added: bool = False) -> DataFrame:
    """Pieces of the documents (doc_id, text) with their ids, as in SCHEMA; ``added`` as in tokens.VocabularyCoder."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed(path, capacity, end_id, pool_tokens, added), SCHEMA)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: packs all documents."""
    pieces = pack(read_documents(spark, sf_dir), _vocabulary(), added=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the documents that are left."""
    return pack(docs, _vocabulary(), added=True).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

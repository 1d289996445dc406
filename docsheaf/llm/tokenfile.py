"""Token-id files coded by a static range asymmetric numeral system (rANS).

Format.  A dataset is a folder of Parquet files, in ascending document order by file name.  Each row is a
segment of whole documents: document ids and token counts, one frequency table that all of its
blocks share, and the blocks.  A block is LANES interleaved rANS coders (64-bit states, 32-bit words,
20-bit frequencies) over STEPS times LANES tokens; it holds the coders' states and the place in its words
at every checkpoint (each CHECK steps), so any stretch between checkpoints is decoded by itself,
and a checksum of its tokens.  Spark's commit protocol makes a file whole or absent.

Numbers are little-endian.  A table is the zlib-compressed 32-bit frequencies of ids 0, 1, ...

Defined cases: a null or empty text is just the end id; documents with equal ids stand next to each other
in any order; null ids come first; an empty table gives a folder without segments; further columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsheaf.llm import tokens
from docsheaf.llm.shared import new_path, read_documents

BITS, LANES, STEPS, CHECK = 20, 2048, 256, 128
LOW = np.uint64(1 << 31)
SEGMENT_TOKENS, END_ID = 1_500_000, 2
BLOCK_TYPE = pa.struct([("n", pa.int32()), ("crc", pa.int64()), ("steps", pa.int32()), ("lanes", pa.int32()), ("states", pa.binary()), ("offsets", pa.list_(pa.int32())), ("words", pa.binary())])
SEGMENT_SCHEMA = "segment long, n_tokens long, doc_ids array<bigint>, doc_tokens array<int>, table binary, blocks array<struct<n: int, crc: bigint, steps: int, lanes: int, states: binary, offsets: array<int>, words: binary>>"
SEGMENT_TYPE = pa.schema([("segment", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("table", pa.binary()), ("blocks", pa.list_(BLOCK_TYPE))])


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Frequencies of ids 0..max that sum to 2**BITS; every id that occurs has one at least."""
    counts = np.bincount(ids).astype(np.int64)
    present = counts > 0
    spare = (1 << BITS) - int(present.sum())
    if spare < 0:
        raise ValueError("more distinct ids than the table can hold")
    out = np.where(present, counts * spare // max(len(ids), 1) + 1, 0)
    out[counts.argmax()] += (1 << BITS) - int(out.sum())
    return out.astype(np.uint32)


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, filler: int) -> dict:
    """One block; see the module's text.  Short blocks use fewer lanes."""
    lanes = min(LANES, max(1, len(ids) // 64))
    steps = -(-len(ids) // lanes)
    grid = np.full(steps * lanes, filler, dtype=np.int64)
    grid[: len(ids)] = ids
    f, c = freq[grid].reshape(steps, lanes), start[grid].reshape(steps, lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words, wrote = np.zeros((steps, lanes), dtype=np.uint32), np.zeros((steps, lanes), dtype=bool)
    limit_shift, word, bits = np.uint64(31 - BITS + 32), np.uint64(32), np.uint64(BITS)
    states = []
    for step in range(steps - 1, -1, -1):
        over = state >= (f[step] << limit_shift)
        words[step], wrote[step] = state.astype(np.uint32), over
        state = np.where(over, state >> word, state)
        high = state // f[step]
        state = (high << bits) + (state - high * f[step]) + c[step]
        if step % CHECK == 0:
            states.append(state)
    written = np.concatenate([[0], np.cumsum(wrote.sum(axis=1))])
    return {
        "n": len(ids),
        "crc": zlib.crc32(ids.astype("<u4").tobytes()),
        "steps": steps,
        "lanes": lanes,
        "states": b"".join(s.astype("<u8").tobytes() for s in reversed(states)),
        "offsets": written[:steps:CHECK].tolist(),
        "words": words[wrote].astype("<u4").tobytes(),
    }


def decode_block(block: dict, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The ids of a block.  All stretches between checkpoints are decoded side by side."""
    steps, lanes, n = block["steps"], block["lanes"], block["n"]
    chains = -(-steps // CHECK)
    state = np.frombuffer(block["states"], dtype="<u8").reshape(chains, lanes).copy()
    words = np.concatenate([np.frombuffer(block["words"], dtype="<u4"), np.zeros(1, dtype="<u4")]).astype(np.uint64)
    at = np.array(block["offsets"], dtype=np.int64)
    grid = np.zeros((chains, CHECK, lanes), dtype=np.uint32)
    mask, bits, word = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for step in range(min(CHECK, steps)):
        live = chains if step < steps - (chains - 1) * CHECK else chains - 1
        x = state[:live]
        slot = x & mask
        ids = symbol[slot.astype(np.int64)]
        grid[:live, step] = ids
        x = freq[ids] * (x >> bits) + slot - start[ids]
        need = x < LOW
        taken = at[:live, None] + np.cumsum(need, axis=1)
        x = np.where(need, (x << word) | words[np.minimum(taken - 1, len(words) - 1)], x)
        at[:live] = taken[:, -1]
        state[:live] = x
    out = grid.ravel()[:n]
    if zlib.crc32(out.astype("<u4").tobytes()) != block["crc"]:
        raise ValueError("a block's checksum differs: the file is damaged")
    return out


def encode_segment(ids: np.ndarray) -> tuple[bytes, list[dict]]:
    """The table and the blocks of a segment."""
    freq = frequencies(ids).astype(np.uint64)
    start = np.cumsum(freq) - freq
    size = LANES * STEPS
    return zlib.compress(freq.astype("<u4").tobytes(), 1), [encode_block(ids[k : k + size], freq, start, int(freq.argmax())) for k in range(0, len(ids), size)]


def decode_segment(table: bytes, blocks: list[dict]) -> np.ndarray:
    freq = np.frombuffer(zlib.decompress(table), dtype="<u4").astype(np.uint64)
    start = np.cumsum(freq) - freq
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    parts = [decode_block(b, freq, start, symbol) for b in blocks]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def _segments(vocabulary: str, end_id: int, segment_tokens: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.vocabulary_coder(vocabulary, added)
        end = np.array([end_id], dtype=np.uint32)
        following = TaskContext.get().partitionId() << 24
        docs: list = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            table, blocks = encode_segment(np.concatenate([x for ids in held for x in (ids, end)]))
            counts = [len(ids) + 1 for ids in held]
            row = {"segment": following, "n_tokens": sum(counts), "doc_ids": docs, "doc_tokens": counts, "table": table, "blocks": blocks}
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT_TYPE)

        total = 0
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text")), strict=True):
                    docs.append(doc)
                    held.append(ids)
                    total += len(ids) + 1
                    if total >= segment_tokens:
                        yield flush()
                        docs, held, total, following = [], [], 0, following + 1
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS, added: bool = False) -> None:
    """Writes (doc_id, text) as token files, ascending by doc_id; ``added`` as in tokens.VocabularyCoder.

    Rows are dealt by ranges of doc_id, at most spark.sql.shuffle.partitions files of which Spark joins small
    ones; among equal ids a hash of the text goes on, so one id, or none, with very many rows spreads too.  A
    task holds one segment, whatever the size of its file.
    """
    salted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("salt", F.xxhash64("text"))
    dealt = salted.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "text")
    dealt.mapInArrow(_segments(vocabulary, end_id, segment_tokens, added), SEGMENT_SCHEMA).write.option("parquet.block.size", 16 << 20).option("compression", "uncompressed").parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            counts = np.array(row["doc_tokens"], dtype=np.int64)
            ids = decode_segment(row["table"], row["blocks"]).astype("<u4")
            starts = np.cumsum(counts) - counts
            for at in range(0, len(counts), 500):
                part = slice(at, at + 500)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * len(counts[part]), pa.int64()),
                        pa.array(row["doc_ids"][part], pa.int64()),
                        pa.array(starts[part]),
                        pa.array(counts[part]),
                        pa.array([ids[s : s + n].tobytes() for s, n in zip(starts[part].tolist(), counts[part].tolist(), strict=True)], pa.binary()),
                    ],
                    names=["segment", "doc_id", "start", "n_tokens", "ids"],
                )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: segment, doc_id, start (within the segment), n_tokens, ids (32-bit little-endian)."""
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path).mapInArrow(_decoded, "segment long, doc_id long, start long, n_tokens long, ids binary")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(segment, before): tokens of all segments before it; summed per file, then over the files."""
    sizes = spark.read.schema(SEGMENT_SCHEMA).parquet(path).select("segment", "n_tokens", F.shiftright("segment", 24).alias("file"))
    files = sizes.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("within", within).join(files, "file").select("segment", (F.col("file_start") + F.col("within")).alias("before"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: writes all documents as token files and reads them back."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    write(read_documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), added=True)
    docs = read(spark, path).select("segment", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(segment_starts(spark, path), "segment").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")

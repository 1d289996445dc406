"""Sharding by a keyed Feistel permutation of global row numbers.

Rows are numbered 0 to N-1 by id (global, gapless).  A four-round Feistel network over the smallest
even number of bits that holds N, with cycle walking (values outside 0..N-1 are permuted again),
permutes the numbers.  Position p of the shuffled order lies in shard ``p % shards`` at slot
``p // shards``: shards differ by one row at most, slots have no gaps, and shard and slot of any row
can be computed from its number and the seed alone.

Only ids, sizes and checksums are sorted, never texts.

Defined cases: a null text has size 1 (no bytes, plus one) and checksum 0, as an empty one; rows
with equal or null ids are ordered by checksum and size, so equal rows are interchangeable; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsheaf.llm.shared import cut, free_name, read_documents, whole_text

SHARDS = 16
SEED = 20261
ROUNDS = 4


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) of x + key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % 2**64 for i in range(ROUNDS)]


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places of row numbers in the shuffled order of n rows; a bijection of 0..n-1."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low, bits, keys = np.uint64((1 << half) - 1), np.uint64(half), _round_keys(seed)
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> bits, x & low
        for key in keys:
            left, right = right, left ^ (_mixed(right, key) & low)
        out[walking] = x = (left << bits) | right
        walking = walking[x >= np.uint64(n)]
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """``df`` (cut) with gapless global row numbers from 0 in the given order.

    A range shuffle sorts, each partition counts its rows, and running sums of those counts, one row per
    partition, are joined back.  The sorted rows are cut first, since range bounds may differ between runs.
    """
    at, part, before = (free_name(df, c) for c in ("at", "part", "before"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ranged.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    running = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(running), F.lit(0)).alias(before))
    number = F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(cut(counts), part).withColumn(name, number).drop(at, part, before)


def shuffled_place(number: Column, n: int, seed: int = SEED) -> Column:
    """The permuted place of a row number column."""

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    return place(number)


def shard(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with shard (int) and slot (long) under the ``rows`` law."""
    number, place = free_name(df, "number"), free_name(df, "place")
    rows = numbered(df, order, number)
    placed = rows.withColumn(place, shuffled_place(F.col(number), rows.count(), seed))
    return placed.select(*df.columns, (F.col(place) % shards).cast("int").alias("shard"), F.floor(F.col(place) / shards).cast("long").alias("slot"), F.col(number).alias("row_number"))


def write_shards(df: DataFrame, sharded: DataFrame, id_col: str, path: str) -> None:
    """Writes the rows of ``df``, joined to their shard and slot by id, as one folder per shard in slot order."""
    rows = df.join(sharded.select(id_col, "shard", "slot"), id_col)
    rows.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents into 16 shards, counts at most one apart."""
    text = whole_text("text")
    docs = read_documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shard(docs, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

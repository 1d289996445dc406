"""Structured Streaming: intake without repeats, latest status, quotas, lock-out."""

from __future__ import annotations

from datetime import timedelta
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unique_uploads(stream: DataFrame, at: str, file_hash: str, horizon: str) -> DataFrame:
    """The first arrival of each hash within the horizon; state older than it is dropped."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark([file_hash])


def intake(stream: DataFrame, history_path: str, checkpoint: str, file_hash: str) -> StreamingQuery:
    """Appends what history does not have yet, batch by batch; repeats of a hash within a batch keep one row.

    Rows without a hash are all kept.  Each batch is a folder of history (column ``batch``) that a second run of the
    batch replaces, so nothing is written twice; a history belongs to one checkpoint.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hashed, bare = batch.filter(F.col(file_hash).isNotNull()), batch.filter(F.col(file_hash).isNull())
        fresh = hashed.dropDuplicates([file_hash])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(history_path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            known = spark.read.schema(T.StructType([*batch.schema, T.StructField("batch", T.LongType())])).parquet(history_path)
            fresh = fresh.join(known.filter(F.col("batch") != number).select(file_hash), file_hash, "left_anti")
        fresh.unionByName(bare).write.mode("overwrite").parquet(f"{history_path}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stream: DataFrame, key: str, at: str) -> DataFrame:
    """Last seen time per key, for update mode."""
    return stream.groupBy(key).agg(F.max(at).alias("last_seen"))


def daily_use(stream: DataFrame, at: str, watermark: str = "1 day") -> DataFrame:
    """Uses per local (UTC+8) day: windows of a day that begin at 16:00 UTC."""
    return stream.withWatermark(at, watermark).groupBy(F.window(at, "1 day", startTime="16 hours")).agg(F.count("*").alias("used"))


_STATE, _OUT = "fails int, until timestamp", "user_id long, at timestamp, until timestamp"


def _lock(limit: int, minutes: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, until = state.get if state.exists else (0, None)
        until = None if until is None else pd.Timestamp(until)
        out = []
        for at, failed in sorted((t for f in frames for t in zip(f["at"], f["failed"], strict=True)), key=lambda t: (t[0], bool(t[1]))):
            if until is not None and at < until:
                continue
            until = None
            fails = fails + 1 if failed else 0
            if fails >= limit:
                until, fails = at + pd.Timedelta(minutes=minutes), 0
                out.append((key[0], at, until))
        state.update((fails, None if until is None else until.to_pydatetime()))
        yield pd.DataFrame(out, columns=["user_id", "at", "until"])

    return step


def lock_outs(stream: DataFrame, limit: int = 5, minutes: int = 15) -> DataFrame:
    """(user_id, at, until) whenever a user fails ``limit`` times in a row; events while locked do not count.

    ``stream`` has user_id, at, failed, in order within a batch and across batches.
    """
    return stream.groupBy("user_id").applyInPandasWithState(_lock(limit, minutes), _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def lock_outs_batch(events: DataFrame, limit: int = 5, minutes: int = 15) -> DataFrame:
    """The same for a table: each user's events pass in order, and only a counter and the end of a lock are held.

    Events without a user are those of one user, as in the stream; events without a time are left out.
    """
    length = timedelta(minutes=minutes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, fails, until = object(), 0, None
        for rows in batches:
            out = []
            for who, at, failed in zip(*[rows.column(c).to_pylist() for c in ("user_id", "at", "failed")], strict=True):
                if who != user:
                    user, fails, until = who, 0, None
                if until is not None and at < until:
                    continue
                fails, until = (fails + 1 if failed else 0), None
                if fails >= limit:
                    fails, until = 0, at + length
                    out.append((who, at, until))
            kinds = [rows.schema.field("user_id").type, rows.schema.field("at").type, rows.schema.field("at").type]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["user_id", "at", "until"])

    known = events.filter(F.col("at").isNotNull()).select("user_id", "at", F.coalesce("failed", F.lit(False)).alias("failed"))
    return known.repartition("user_id").sortWithinPartitions("user_id", "at", "failed").mapInArrow(run, T.StructType([events.schema["user_id"], events.schema["at"], T.StructField("until", events.schema["at"].dataType)]))


def retry_eligible(tasks: DataFrame, key: str, most: int) -> DataFrame:
    """Latest task events that failed and may be tried again, or that a restart interrupted."""
    w = Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("id").desc())
    last = tasks.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return last.withColumn("action", F.when((F.col("status") == "failed") & (F.col("attempt") <= most), "retry").when(F.col("status") == "running", "requeue")).filter("action is not null")

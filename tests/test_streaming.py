import random
from datetime import datetime, timedelta

from docsheaf.streaming import intake

T0 = datetime(2024, 1, 1)


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(query_writer, name, mode, checkpoint):
    q = query_writer.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_intake_appends_each_hash_once(spark, tmp_path):
    src, out, schema = f"file://{tmp_path}/src", f"file://{tmp_path}/out", "id int, sha string, at timestamp"
    write(spark, src, [(1, "a", T0), (2, "a", T0), (3, "b", T0)], schema)
    intake.intake(stream(spark, src, schema), out, f"file://{tmp_path}/c", "sha").awaitTermination()
    write(spark, src, [(4, "b", T0), (5, "c", T0), (6, None, T0), (7, None, T0)], schema)
    intake.intake(stream(spark, src, schema), out, f"file://{tmp_path}/c", "sha").awaitTermination()
    assert sorted(r["sha"] or "-" for r in spark.read.parquet(out).collect()) == ["-", "-", "a", "b", "c"]
    again = spark.read.parquet(src).filter("id > 3")
    for _ in range(2):  # a batch that is run again replaces its own rows
        intake.intake(spark.readStream.schema(schema).parquet(src), f"{out}2", f"file://{tmp_path}/c{_}", "sha").awaitTermination()
    assert again.count() == 4 and spark.read.parquet(f"{out}2").count() == 5


def test_unique_uploads_and_latest(spark, tmp_path):
    src, schema = f"file://{tmp_path}/src", "id int, sha string, at timestamp"
    write(spark, src, [(1, "a", T0), (2, "a", T0 + timedelta(minutes=5)), (3, "b", T0)], schema)
    drained(intake.unique_uploads(stream(spark, src, schema), "at", "sha", "1 hour"), "uploads", "append", f"file://{tmp_path}/c1")
    assert sorted(r["sha"] for r in spark.table("uploads").collect()) == ["a", "b"]
    drained(intake.latest(stream(spark, src, schema), "sha", "at"), "latest", "complete", f"file://{tmp_path}/c2")
    assert {r["sha"]: r["last_seen"] for r in spark.table("latest").collect()} == {"a": T0 + timedelta(minutes=5), "b": T0}


def test_local_day_windows(spark, tmp_path):
    src, schema = f"file://{tmp_path}/src", "at timestamp"
    write(spark, src, [(datetime(2024, 1, 1, 15, 59),), (datetime(2024, 1, 1, 16, 0),), (datetime(2024, 1, 2, 1, 0),)], schema)
    drained(intake.daily_use(stream(spark, src, schema), "at"), "daily", "complete", f"file://{tmp_path}/c")
    assert sorted((r["window"]["start"], r["used"]) for r in spark.table("daily").collect()) == [(datetime(2023, 12, 31, 16), 1), (datetime(2024, 1, 1, 16), 2)]


def test_lock_out_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    src, schema = f"file://{tmp_path}/src", "user_id long, at timestamp, failed boolean"
    rows = [(rng.randint(1, 4), T0 + timedelta(minutes=3 * k), rng.random() < 0.7) for k in range(240)]
    for k in range(0, 240, 80):
        write(spark, src, rows[k : k + 80], schema)
    want = sorted(map(tuple, intake.lock_outs_batch(spark.createDataFrame(rows, schema), 3, 20).collect()))
    q = intake.lock_outs(spark.readStream.schema(schema).parquet(src), 3, 20).writeStream.format("memory").queryName("locks").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("locks").collect())) == want and want


def test_retry(spark):
    rows = [(1, 10, "failed", 1, T0), (2, 10, "running", 2, T0 + timedelta(1)), (3, 11, "failed", 3, T0), (4, 12, "failed", 2, T0)]
    df = spark.createDataFrame(rows, "id int, report_id int, status string, attempt int, created_at timestamp")
    assert sorted((r["id"], r["action"]) for r in intake.retry_eligible(df, "report_id", 2).collect()) == [(2, "requeue"), (4, "retry")]

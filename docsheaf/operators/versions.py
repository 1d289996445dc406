"""Version chains, newest rows, duplicates by hash, status logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order.

    A window filter on rank 1, which Spark pushes below the shuffle as a group limit: a hot key sends one
    row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def newest_per_hash(df: DataFrame, file_hash: str, tie: str) -> DataFrame:
    """The newest row of every file hash; rows without a hash are all kept."""
    known = newest(df.filter(F.col(file_hash).isNotNull()), [file_hash], [F.col(tie).desc()])
    return known.unionByName(df.filter(F.col(file_hash).isNull()))


def duplicates(df: DataFrame, file_hash: Column, tie: str) -> DataFrame:
    """Every row with the first id of its hash; ``existing_id`` differs from its own where it is a duplicate."""
    hashed = df.withColumn("__hash", file_hash)
    first = hashed.groupBy("__hash").agg(F.min(tie).alias("existing_id"))
    return hashed.join(first, "__hash").drop("__hash")


def leaves(df: DataFrame, own: str = "id", parent: str = "parent_id") -> DataFrame:
    """Rows that no other row has as its parent: the latest revisions."""
    parents = df.select(F.col(parent).alias("__parent")).filter("__parent is not null").distinct()
    return df.join(parents, df[own] == parents["__parent"], "left_anti")


def timeline(df: DataFrame, chain: str, order: list[str], changed: str) -> DataFrame:
    """Numbered revisions of each chain with the value before."""
    w = Window.partitionBy(chain).orderBy(*order)
    return df.withColumns({"revision": F.row_number().over(w), "previous": F.lag(changed).over(w)})


def next_numbers(new: DataFrame, existing: DataFrame, key: str, number: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the largest number of their key, 1 if there is none."""
    last = existing.groupBy(key).agg(F.max(number).alias("__last"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.withColumn("__rank", rank).join(last, key, "left").withColumn(number, (F.coalesce("__last", F.lit(0)) + F.col("__rank")).cast("long")).drop("__rank", "__last")


def latest_status(log: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """The values of the last event of each key; an aggregate, so each task sends one row per key."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return log.groupBy(key).agg(last.alias("__v")).select(key, "__v.*")


def activated(versions: DataFrame, chosen: Column) -> DataFrame:
    """The chosen version active, other active ones archived, the rest as they are."""
    return versions.withColumn("status", F.when(chosen, "active").when(F.col("status") == "active", "archived").otherwise(F.col("status")))


def append_verdicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New revisions (id, parent_id, chain, file_hash) with why they are rejected, NULL if they may be appended.

    The parent must exist and be finished, be the latest of its chain, belong to the same chain, and the file be new.
    """
    parents = existing.select(F.col("id").alias("parent_id"), F.col("status").alias("__status"), F.col("chain").alias("__chain"))
    latest = leaves(existing).select(F.col("id").alias("parent_id"), F.lit(True).alias("__leaf"))
    hashes = existing.select("file_hash").filter("file_hash is not null").distinct().withColumn("__known", F.lit(True))
    df = new.join(parents, "parent_id", "left").join(latest, "parent_id", "left").join(hashes, "file_hash", "left")
    reason = (
        F.when(F.col("__chain").isNull(), "parent_missing")
        .when(F.col("__status") != "done", "parent_not_finished")
        .when(F.col("__leaf").isNull(), "parent_not_latest")
        .when(F.col("__chain") != F.col("chain"), "other_application")
        .when(F.col("__known"), "file_known")
    )
    return df.withColumn("reason", reason).select(*new.columns, "reason")


def regression(cases: DataFrame, results: DataFrame, key: str, pairs: dict[str, str]) -> DataFrame:
    """Cases with their stored results; ``passed`` if all pairs agree, NULL agreeing with NULL."""
    df = cases.join(results, key, "left")
    ok = F.lit(True)
    for expected, actual in pairs.items():
        ok = ok & F.col(expected).eqNullSafe(F.col(actual))
    return df.withColumn("passed", ok)


def roots(reports: DataFrame) -> DataFrame:
    """(id, root_id) of reports (id, parent_id) whose roots are lost: pointers are doubled until none moves.

    Each round joins once and halves the way, so the longest chain of n reports takes log2 n rounds; what still moves then is, or
    leads into, a cycle.  Those have no root: a root is a report without another parent, or a parent that has no row.
    """
    from docsheaf.operators.lineage import settled

    first = settled(reports.select("id", F.coalesce("parent_id", "id").alias("up")))
    jumps, rounds = first, first.count().bit_length() + 1
    for _ in range(rounds):
        ahead = jumps.select(F.col("id").alias("up"), F.col("up").alias("next"))
        step = settled(jumps.join(ahead, "up", "left").select("id", "up", F.coalesce("next", "up").alias("next")))
        moved = step.filter("next <> up").limit(1).count()
        jumps = step.select("id", F.col("next").alias("up"))
        if not moved:
            break
    ends = first.select(F.col("id").alias("up"), (F.col("up") != F.col("id")).alias("inner"))
    return jumps.join(ends, "up", "left").select("id", F.when(F.coalesce("inner", F.lit(False)), None).otherwise(F.col("up")).alias("root_id"))

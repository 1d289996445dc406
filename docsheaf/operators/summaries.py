"""Dashboards: counters, trends, histograms, trees."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of conditional counts, in one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def daily_trend(df: DataFrame, at: str, last_day: Column, days: int = 7) -> DataFrame:
    """(day, n) of the last days, zero where nothing happened."""
    first = F.date_sub(last_day, days - 1)
    per = df.filter((F.to_date(at) >= first) & (F.to_date(at) <= last_day)).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(first, last_day)).alias("day"))
    return calendar.join(per, "day", "left").select("day", F.date_format("day", "MM-dd").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, by: list[str], column: str, domain: list[str]) -> DataFrame:
    """One column per value of a fixed domain, zero where there is none."""
    return df.groupBy(*by).pivot(column, domain).count().fillna(0, domain)


def tree_counts(df: DataFrame, levels: list[str]) -> DataFrame:
    """Leaf counts of every node of a tree of fixed depth: one roll-up; ``depth`` tells a total from a NULL label."""
    return df.rollup(*levels).agg(F.count("*").alias("leaves"), (len(levels) - F.length(F.regexp_replace(F.bin(F.grouping_id()), "0", ""))).cast("int").alias("depth"))


def local_days(df: DataFrame, at: str, hours: int = 8) -> DataFrame:
    """Adds the local day of a UTC time."""
    return df.withColumn("local_day", F.to_date(F.col(at) + F.make_interval(hours=F.lit(hours))))


def quota(df: DataFrame, at: str, by: list[str], limit: int, hours: int = 8) -> DataFrame:
    """Uses per local day and whether they reach the limit."""
    per = local_days(df, at, hours).groupBy(*by, "local_day").agg(F.count("*").alias("used"))
    return per.withColumn("exhausted", F.col("used") >= limit)


def envelope(df: DataFrame, keys: list[str], low: str, high: str, values: str, flag: str) -> DataFrame:
    """Least and largest bounds, union of value lists, OR of flags."""
    return df.groupBy(*keys).agg(F.min(low).alias("low"), F.max(high).alias("high"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(values)))).alias("values"), F.bool_or(flag).alias("flag"))


def guard_summary(records: DataFrame) -> DataFrame:
    """Calls, allowed, blocked and the sorted types of findings."""
    return records.agg(F.count("*").alias("calls"), F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row results as one row."""
    return functools.reduce(DataFrame.crossJoin, rows)


def governance_summary(corrections: DataFrame, rules: DataFrame, cases: DataFrame, versions: DataFrame, runs: DataFrame, knowledge: str = "unknown") -> DataFrame:
    """One row: pending corrections, draft rules, enabled cases, the active version and the last regression run.

    Of several active versions the one with the least id counts; without one the version is the base version, and
    without a run its columns are NULL.  ``knowledge`` stands in where the version names no knowledge version.
    """
    newest = lambda *columns: [F.max_by(c, "id").alias(f"run_{c}") for c in columns]
    active = versions.filter("status = 'active'").agg(F.min("id").alias("active_id"), *[F.min_by(F.col(c), F.col("id")).alias(f"__{c}") for c in ("version_no", "name", "knowledge_version")])
    named = active.select(
        "active_id",
        F.when(F.col("active_id").isNull(), "基础版").otherwise(F.concat(F.lit("V"), F.col("__version_no").cast("string"))).alias("iteration_version"),
        F.coalesce("__name", F.lit("")).alias("iteration_name"),
        F.coalesce(F.nullif(F.trim("__knowledge_version"), F.lit("")), F.lit(knowledge)).alias("knowledge_version"),
    )
    return side_by_side(
        counters(corrections, pending_corrections=F.col("status") == "pending"),
        counters(rules, draft_rules=F.col("status") == "draft"),
        counters(cases, regression_cases=F.col("enabled")),
        named,
        runs.agg(F.max("id").alias("run_id"), *newest("total", "passed", "failed")),
    )


def first_per_part(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """For each key and field the first value that is not blank, by order."""
    return df.groupBy(key).agg(*[F.min_by(F.when(F.trim(f) != "", F.col(f)), F.when(F.trim(f) != "", F.col(order))).alias(f) for f in fields])

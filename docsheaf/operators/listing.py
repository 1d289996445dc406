"""Lists of reports and companies: optional filters, pages, semi and anti joins, roll-ups."""

from __future__ import annotations

import functools
import operator
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_like(columns: list[str], text: str) -> Column:
    """Case-insensitive containment in any of the columns; a NULL column does not match."""
    return functools.reduce(operator.or_, [F.coalesce(F.ilike(F.col(c), F.lit(f"%{text}%")), F.lit(False)) for c in columns])


def filtered(df: DataFrame, equal: dict | None = None, like: dict | None = None, start: datetime | None = None, end: datetime | None = None, at: str = "created_at", search: tuple[list[str], str] | None = None) -> DataFrame:
    """Applies the predicates that are given; ``equal`` values of None ask for NULL, dates are [start, end)."""
    for name, value in (equal or {}).items():
        df = df.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    for name, text in (like or {}).items():
        df = df.filter(F.ilike(F.col(name), F.lit(f"%{text}%")))
    if start is not None:
        df = df.filter(F.col(at) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(at) < F.lit(end))
    return df.filter(any_like(*search)) if search else df


def page(df: DataFrame, newest: str, tie: str, number: int = 1, size: int = 20, largest: int = 100) -> DataFrame:
    """One page, newest first; the id breaks ties, so that pages neither overlap nor miss rows."""
    size = max(1, min(size, largest))
    return df.orderBy(F.col(newest).desc(), F.col(tie).desc()).offset((max(number, 1) - 1) * size).limit(size)


def with_any(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def without(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def pending(df: DataFrame, active: DataFrame, on: str, order: list[Column], first: int) -> DataFrame:
    """The first rows, in order, that nothing active stands for."""
    return without(df, active, on).orderBy(*order).limit(first)


def roll_up(parents: DataFrame, children: DataFrame, on: str, count_of: str, latest_of: str, latest_when: Column) -> DataFrame:
    """Parents with the number of distinct children and the latest time among those that qualify; children are aggregated before the join, and parents without any are kept."""
    per = children.groupBy(on).agg(F.count_distinct(count_of).alias("n"), F.max(F.when(latest_when, F.col(latest_of))).alias("latest"))
    return parents.join(per, on, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def enriched(rows: DataFrame, *lookups: tuple[DataFrame, str, str, list[str]]) -> DataFrame:
    """Left joins of (table, its key, the row's key, columns renamed with the row's key in front)."""
    for table, its, own, columns in lookups:
        side = table.select(F.col(its).alias(f"__{own}"), *[F.col(c).alias(f"{own}_{c}") for c in columns])
        rows = rows.join(side, rows[own] == side[f"__{own}"], "left").drop(f"__{own}")
    return rows


def blocked_deletes(rows: DataFrame, *dependants: tuple[DataFrame, str]) -> DataFrame:
    """Rows that may not be deleted, with how many dependants each has."""
    ids = functools.reduce(DataFrame.unionAll, [d.select(F.col(c).alias("id")) for d, c in dependants]).filter("id is not null")
    return rows.join(ids.groupBy("id").agg(F.count("*").alias("dependants")), "id")


def retained(rows: DataFrame, at: str, days: int, as_of: Column, batch: int = 200) -> DataFrame:
    """The oldest rows past the retention time, one batch; none if days is 0."""
    old = rows.filter(F.col(at) < as_of - F.make_interval(days=F.lit(days))) if days else rows.limit(0)
    return old.orderBy(at, "id").limit(batch)

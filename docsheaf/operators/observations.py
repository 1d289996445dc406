"""Measurements read from boxes and grids: by header columns, by neighbours, by element rows; each with a reason where it fails."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsheaf.operators import segments


def coordinate_rows(boxes: DataFrame, keys: list[str], headers: dict[str, Sequence[str]], gap: float = 6.0) -> DataFrame:
    """(keys, row, a column per role, reason) of boxes (left, right, top, text) below a page's header.

    Every role must stand in the header once.  A box belongs to the role whose header is nearest to its middle; rows are
    stretches of boxes without a vertical gap.  Two boxes of one role in a row leave it open.  The boxes are read once:
    windows over a page carry its header to its rows, so nothing is joined or broadcast.
    """
    plain = F.regexp_replace("text", r"(?U)\s+", "")
    role = F.coalesce(*[F.when(plain.isin(*words), F.lit(name)) for name, words in headers.items()], F.lit(None).cast("string"))
    middle = (F.col("left") + F.col("right")) / 2
    page = Window.partitionBy(*keys).orderBy("top").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = boxes.withColumns({"__role": role, "__x": middle})
    once = [F.count_if(F.col("__role") == r).over(page) == 1 for r in headers]
    heads = F.array(*[F.struct(F.max(F.when(F.col("__role") == r, F.col("__x"))).over(page).alias("x"), F.lit(r).alias("role")) for r in headers])
    seen = marked.withColumns({"__good": functools.reduce(operator.and_, once, F.lit(True)), "__top": F.max(F.when(F.col("__role").isNotNull(), F.col("top"))).over(page), "__heads": heads})
    body = functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys], F.col("__good") & F.col("__role").isNull() & (F.col("top") > F.col("__top")))
    kept = seen.filter(body | (~F.col("__good") & F.col("__role").isNotNull()))
    nearest = F.array_min(F.transform("__heads", lambda h: F.struct(F.abs(h["x"] - F.col("__x")).alias("d"), h["role"].alias("role"))))["role"]
    lined = segments.islands(kept.withColumn("__own", F.when(F.col("__good"), nearest)), keys, "top", gap, "row")
    cells = [F.min(F.when(F.col("__own") == r, F.col("text"))).alias(r) for r in headers]
    crowded = F.greatest(*[F.count_if(F.col("__own") == r) for r in headers]) > 1 if len(headers) > 1 else F.count("*") > 1
    numbered = lined.withColumn("row", F.when(F.col("__good"), F.col("row").cast("long")))
    return numbered.groupBy(*keys, "row").agg(*cells, F.when(F.col("row").isNull(), "header_not_unique").when(crowded, "several_values").alias("reason"))


def labelled_boxes(boxes: DataFrame, keys: list[str], labels: dict[str, str], value: str, height: float = 5.0) -> DataFrame:
    """(keys, item, value, reason): for each label box the one box to its right, in its line, that is a value."""
    item = F.coalesce(*[F.when(F.regexp_like("text", F.lit(p)), F.lit(n)) for n, p in labels.items()], F.lit(None).cast("string"))
    named = boxes.withColumn("item", item).filter("item is not null").select(*keys, "item", F.col("right").alias("__from"), F.col("top").alias("__y"))
    values = boxes.filter(F.regexp_like(F.trim("text"), F.lit(f"^(?:{value})$"))).select(*keys, F.col("left").alias("__at"), F.col("top").alias("__vy"), F.trim("text").alias("__value"))
    hits = named.join(values.hint("merge"), keys).filter((F.col("__at") >= F.col("__from")) & (F.abs(F.col("__vy") - F.col("__y")) <= height))
    per = hits.groupBy(*keys, "item").agg(F.count("*").alias("__n"), F.min("__value").alias("value"))
    times = named.groupBy(*keys, "item").agg(F.count("*").alias("__labels"))
    reason = F.when(F.col("__labels") > 1, "label_not_unique").when(F.col("__n").isNull(), "no_value").when(F.col("__n") > 1, "several_values")
    return times.join(per.hint("merge"), [*keys, "item"], "left").select(*keys, "item", F.when(reason.isNull(), F.col("value")).alias("value"), reason.alias("reason"))


def element_rows(grid: DataFrame, keys: list[str], elements: Sequence[str]) -> DataFrame:
    """(keys, element, specimen, value) of grids (row_no, col_no, text) whose first column names elements and first row specimens."""
    names = grid.filter("row_no = 0 and col_no > 0").select(*keys, "col_no", F.trim("text").alias("specimen"))
    rows = grid.filter(F.col("col_no") == 0).select(*keys, "row_no", F.trim("text").alias("element")).filter(F.col("element").isin(*elements))
    return grid.join(rows.hint("merge"), [*keys, "row_no"]).join(names.hint("merge"), [*keys, "col_no"]).select(*keys, "element", "specimen", F.trim("text").alias("value"))


def same_issue(a_concept: Column, b_concept: Column, a: Column, b: Column) -> Column:
    """Equal concepts if both have one, else one label's words in the other's."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\W+", "")
    x, y = plain(a), plain(b)
    return F.when(a_concept.isNotNull() & b_concept.isNotNull(), a_concept == b_concept).otherwise((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)))


def looked_up(rows: DataFrame, dimension: DataFrame, on: list[str], take: list[str]) -> DataFrame:
    """Exact lookup in a dimension table; a key that stands there twice answers nothing."""
    per = dimension.groupBy(*on).agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in take]).filter("__n = 1").drop("__n")
    return rows.join(per, on, "left")


def unique_values(values: Column, placeholders: Sequence[str] = ("[企业名称已脱敏]", "[申请编号已脱敏]"), least: int = 3) -> Column:
    """Values without spaces and edge marks, each once, in order; short ones and placeholders left out."""
    clean = F.transform(values, lambda v: F.btrim(F.regexp_replace(v, r"(?U)\s+", ""), F.lit("：:;,，。|<>")))
    return F.array_distinct(F.filter(clean, lambda v: (F.length(v) >= least) & ~v.isin(*placeholders)))


def assignment_errors(expected: DataFrame, assigned: DataFrame, keys: list[str], token: str, slot: str) -> DataFrame:
    """(keys, what, error): tokens that nothing is assigned to, and slots that two tokens took."""
    open_ones = expected.join(assigned.select(*keys, token).distinct(), [*keys, token], "left_anti").select(*keys, F.col(token).cast("string").alias("what"), F.lit("uncovered").alias("error"))
    twice = assigned.groupBy(*keys, slot).agg(F.count_distinct(token).alias("__n")).filter("__n > 1").select(*keys, F.col(slot).cast("string").alias("what"), F.lit("double").alias("error"))
    return open_ones.unionByName(twice)


def review_completed(reports: DataFrame, tasks: DataFrame, key: str, status: str, finished: str) -> DataFrame:
    """Reports with the time their last finished task ended, only if the report itself is done."""
    per = tasks.filter(F.col("task_status") == "done").groupBy(key).agg(F.max(finished).alias("__at"))
    return reports.join(per, key, "left").withColumn("completed_at", F.when(F.col(status) == "done", F.col("__at"))).drop("__at")


def all_issues(report_items: DataFrame, sample_items: DataFrame, columns: list[str]) -> DataFrame:
    """Actionable findings of a report and its samples, each (item, reported, should_be) once per report."""
    both = report_items.select(*columns).unionByName(sample_items.select(*columns))
    w = Window.partitionBy("report_id", "item", "reported", "should_be").orderBy("pos")
    return both.filter("action_required").withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def change_consistent(before: Column, after: Column, reported: Column) -> Column:
    """Places (from 1) of displayed values whose reported change can't follow from what stood before and after."""
    from docsheaf.functions import normalize as N

    ok = F.zip_with(F.arrays_zip(before.alias("b"), after.alias("a")), reported, lambda x, r: F.coalesce(N.display_change_overlap(x["b"], x["a"], r), F.lit(True)))
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(ok), F.lit(1))), lambda i: ~F.coalesce(F.get(ok, i - 1), F.lit(True)))


def change_log(rules: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rules with their changes, newest first within a rule, numbered."""
    w = Window.partitionBy(key).orderBy(F.col("changed_at").desc(), F.col("change_id").desc())
    return rules.join(log, key, "left").withColumn("n", F.row_number().over(w)).orderBy(key, "n")

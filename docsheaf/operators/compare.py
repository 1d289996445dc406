"""Version comparison: fuzzy matches within a chain, resolved and new issues."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9a-zA-Z一-鿿]+", ""))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    def one(x: str, y: str, floor: float) -> float:
        m = SequenceMatcher(None, x, y)
        # Counting characters takes half as long as matching, and rules out hardly a pair where the floor is low.
        return m.ratio() if floor <= 0.5 or m.quick_ratio() >= floor else 0.0

    return pd.Series([one(x, y, f) for x, y, f in zip(a, b, least, strict=True)], dtype=float)


def similarity(a: Column, b: Column, least: float | Column = 0.0) -> Column:
    """1 if one contains the other, 0 if one is empty, else the matching ratio of the whole texts.

    Ratios below ``least`` may come out as 0: lengths, then character counts, bound a ratio from above, and only what
    they leave is matched.
    """
    return _plain_similarity(plain(a), plain(b), least)


def _plain_similarity(x: Column, y: Column, least: float | Column = 0.0) -> Column:
    x, y = F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))
    floor = least if isinstance(least, Column) else F.lit(float(least))
    bound = 2 * F.least(F.length(x), F.length(y)) / (F.length(x) + F.length(y))
    easy = F.when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0).when(bound < floor, 0.0)
    blank = F.lit("")
    return F.coalesce(easy, _ratio(F.when(easy.isNull(), x).otherwise(blank), F.when(easy.isNull(), y).otherwise(blank), floor))


def best_matches(old: DataFrame, new: DataFrame, chain: str, least: float, item_weight: float = 0.8) -> DataFrame:
    """Old issues (chain, id, item, sample) with their best new one and its score; none below ``least``.

    A chain holds the issues of one report's versions, so the pairs within it are few; a pair whose bounds keep it
    below ``least`` is not matched.
    """
    # Texts are made plain once per row, not once per pair.
    o = old.select(chain, "id", plain(F.col("item")).alias("item"), plain(F.col("sample")).alias("sample"))
    n = new.select(chain, F.col("id").alias("new_id"), plain(F.col("item")).alias("__item"), plain(F.col("sample")).alias("__sample"))
    of_sample = (1 - item_weight) * _plain_similarity(F.col("sample"), F.col("__sample"))
    # What the items need at least, as the samples are; the margin is for rounding.
    floor = (least - of_sample) / item_weight - 1e-9
    score = item_weight * _plain_similarity(F.col("item"), F.col("__item"), floor) + of_sample
    scored = o.join(n, chain, "left").withColumn("score", F.when(F.col("new_id").isNotNull(), score))
    best = scored.groupBy(chain, "id").agg(F.max_by(F.struct("new_id", "score"), F.struct("score", -F.col("new_id"))).alias("b"))
    hit = F.col("b.score") >= least
    return best.select(chain, "id", F.when(hit, F.col("b.new_id")).alias("new_id"), F.when(hit, F.round("b.score", 6)).alias("score"))


def version_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Issues of two versions by key: resolved (gone), unresolved (in both), new."""
    a, b = before.select(*keys).distinct().withColumn("__a", F.lit(True)), after.select(*keys).distinct().withColumn("__b", F.lit(True))
    status = F.when(F.col("__a") & F.col("__b"), "unresolved").when(F.col("__a"), "resolved").otherwise("new")
    return a.join(b, keys, "full").withColumn("status", status).drop("__a", "__b")

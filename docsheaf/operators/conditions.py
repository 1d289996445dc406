"""Condition trees in three-valued logic, compiled to Columns.

A tree is a dict: {"op": "all"|"any", "rules": [...]}, {"op": "not", "rule": ...}, or a leaf
{"op": "<"|"<="|">"|">="|"=="|"in"|"not_in"|"between", "field": ..., "value": ... | "min", "max"}.
The result is a nullable boolean, NULL meaning unknown.  Spark's AND, OR and NOT are Kleene's; an empty
``all`` or ``any``, a missing or conflicting field, a failed cast and an unknown operator are unknown.
"""

from __future__ import annotations

import functools
import math
import operator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _unknown() -> Column:
    return F.lit(None).cast("boolean")


def _as_number(value: Any) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


def _equal(field: Column, kind: T.DataType, value: Any) -> Column:
    """Equality across types as Python has it: text never equals a number, booleans count as 0 and 1."""
    if value is None:
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return field == value if isinstance(value, str) else F.lit(False)
    if isinstance(value, str):
        return F.lit(False)
    return field.cast("double") == float(value)


def _leaf(node: dict, schema: dict[str, T.DataType], conflicts: Column | None) -> Column:
    op, name = str(node.get("op") or "").lower(), str(node.get("field") or "")
    if name not in schema:
        return _unknown()
    field, kind = F.col(name), schema[name]
    known = field.isNotNull()
    if conflicts is not None:
        known = known & ~F.coalesce(F.array_contains(conflicts, name), F.lit(False))
    number = field.try_cast("double")
    finite = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")), number)
    if op in _COMPARE:
        wanted = _as_number(node.get("value"))
        out = _unknown() if wanted is None or isinstance(kind, T.BooleanType) else _COMPARE[op](finite, F.lit(wanted))
    elif op == "between":
        low, high = _as_number(node.get("min")), _as_number(node.get("max"))
        out = _unknown() if low is None or high is None else (number >= low) & (number <= high)
    elif op == "==":
        out = _equal(field, kind, node.get("value"))
    elif op in ("in", "not_in"):
        hit = functools.reduce(operator.or_, [_equal(field, kind, v) for v in node.get("value") or []], F.lit(False))
        out = hit if op == "in" else ~hit
    else:
        return _unknown()
    return F.when(known, out)


def compile_condition(node: dict, schema: T.StructType, conflicts: Column | None = None) -> Column:
    """The tree as a nullable boolean Column over fact columns; ``conflicts`` is an array of field names."""
    kinds = {f.name: f.dataType for f in schema.fields}

    def build(n: dict) -> Column:
        op = str(n.get("op") or "").lower()
        if op in ("all", "any"):
            parts = [build(r) for r in n.get("rules") or []]
            return functools.reduce(operator.and_ if op == "all" else operator.or_, parts) if parts else _unknown()
        if op == "not":
            return ~build(n.get("rule") or {})
        return _leaf(n, kinds, conflicts)

    return build(node)


def state_name(condition: Column) -> Column:
    return F.coalesce(condition.cast("string"), F.lit("unknown"))


def state_histogram(df: DataFrame, condition: Column) -> DataFrame:
    """(state, n) over true, false and unknown."""
    return df.groupBy(state_name(condition).alias("state")).agg(F.count("*").alias("n"))


def reconcile_facts(facts: DataFrame, key: str | list[str], field: str = "field", value: str = "value") -> DataFrame:
    """(key, field, value, conflict): a fact stands only if all its sources agree; else it is a tombstone."""
    keys = [key] if isinstance(key, str) else key
    agreed = F.count_distinct(value)
    invalid = F.count_if(F.col(value).isNull()) > 0
    out = facts.groupBy(*keys, field).agg(agreed.alias("__n"), invalid.alias("__bad"), F.min(value).alias("__v"))
    ok = (F.col("__n") == 1) & ~F.col("__bad")
    return out.select(*keys, field, F.when(ok, F.col("__v")).alias(value), (~ok).alias("conflict"))

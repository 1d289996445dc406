"""Specifications such as ``3×(2×0.75)+1×2``: groups of (cores, section), scopes, canonical forms.

Nested brackets are not regular, so the parser is a small Python helper; it runs on distinct specifications
only, which are few, and is joined back.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUPS_TYPE = T.ArrayType(T.StructType([T.StructField("cores", T.IntegerType()), T.StructField("section", T.DoubleType())]))
_NUMBER = re.compile(r"\d+(?:\.\d+)?")


def _plain(spec: str | None) -> str:
    text = re.sub(r"\s+", "", spec or "").translate(str.maketrans("（）＋×xXGg", "()+*****"))
    return re.sub(r"(?i)(?:mm(?:²|2)|平方毫米)$", "", text)


def spec_groups(spec: str | None) -> list[tuple[int, float]]:
    """The groups of a specification; none if any part of it does not parse.

    ``sum := term ('+' term)*``, ``term := (count '*')* section | [count '*'] '(' sum ')'``, read with a stack of open
    brackets: each holds the groups before it and the count that stands in front of it.
    """
    text, at = _plain(spec), 0
    outer: list[tuple[list[tuple[int, float]], int]] = []
    groups: list[tuple[int, float]] = []
    factors: list[str] = []
    closed = False
    while True:
        mark = text[at : at + 1]
        number = _NUMBER.match(text, at)
        if number and not closed and (not factors or factors[-1] == "*"):
            factors.append(number.group())
            at = number.end()
            continue
        if mark == "*" and factors and factors[-1] != "*":
            factors.append("*")
        elif mark == "(" and not closed and (not factors or len(factors) == 2 and factors[0].isdigit() and int(factors[0])):
            outer.append((groups, int(factors[0]) if factors else 1))
            groups, factors = [], []
        elif mark in ("+", ")", ""):
            if not closed:
                numbers = factors[::2]
                if len(numbers) < 2 or factors[-1] == "*" or not all(f.isdigit() for f in numbers[:-1]):
                    return []
                count, section = math.prod(map(int, numbers[:-1])), float(numbers[-1])
                if count <= 0 or section <= 0:
                    return []
                groups = [*groups, (count, section)]
            factors, closed = [], mark == ")"
            if mark == "":
                return [] if outer else groups
            if mark == ")":
                if not outer:
                    return []
                before, times = outer.pop()
                groups = [*before, *[(times * c, s) for c, s in groups]]
        else:
            return []
        at += 1


@F.pandas_udf(GROUPS_TYPE)
def _groups(specs: pd.Series) -> pd.Series:
    return specs.map(lambda s: [{"cores": c, "section": x} for c, x in spec_groups(s)])


def canonical(c: Column) -> Column:
    """One spelling: ``×`` and ``mm²``, no spaces, no trailing zeros; structure kept."""
    text = F.regexp_replace(F.translate(F.regexp_replace(c, r"(?U)\s+", ""), "（）＋*xXGg", "()+×××××"), r"(?i)(?:mm(?:²|2)|平方毫米)$", "")
    text = F.regexp_replace(text, r"(\.\d*?)0+(?!\d)", "$1")
    return F.concat(F.regexp_replace(text, r"\.(?!\d)", ""), F.lit("mm²"))


def with_spec_facts(df: DataFrame, column: str = "spec") -> DataFrame:
    """Adds spec_groups, core_count, section (NULL where several) and canonical_spec (NULL where it does not parse)."""
    distinct = df.select(F.col(column).alias("__spec")).filter("__spec is not null").distinct().withColumn("spec_groups", _groups("__spec"))
    sections = F.array_distinct(F.transform("spec_groups", lambda g: g["section"]))
    facts = distinct.withColumns(
        {
            "core_count": F.when(F.size("spec_groups") > 0, F.aggregate("spec_groups", F.lit(0), lambda a, g: a + g["cores"])),
            "section": F.when(F.size(sections) == 1, sections[0]),
            "canonical_spec": F.when(F.size("spec_groups") > 0, canonical(F.col("__spec"))),
        }
    )
    return df.join(facts, df[column] == facts["__spec"], "left").drop("__spec")

"""Order-dependent reconciliation inside one sample or report; samples are independent groups.

The grouping by containment and the one-to-one consumption of findings depend on the order of rows, so each
group is folded in order by a small function.  A group is the rows of one sample, bounded by the report.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsheaf.operators.folds import fold_groups

#: Endings that do not distinguish projects, and marks between words.
_ENDINGS = (r"(?:数据|项目|试验|检验)?(?:覆盖)?缺失$", r"(?:项目|试验|检验)$")
_MARKS = re.compile(r"[\s、，,;；:：()（）/\\_-]+")


def project_key(label: str | None) -> str:
    text = (label or "").lower()
    for ending in _ENDINGS:
        text = re.sub(ending, "", text)
    return _MARKS.sub("", text)


def same_project(a: str, b: str) -> bool:
    """Equal keys, or one in the other if both have four characters."""
    return bool(a and b) and (a == b or (min(len(a), len(b)) >= 4 and (a in b or b in a)))


def labels_match(a: str | None, b: str | None, common: int = 4) -> bool:
    """Containment, or a common substring of ``common`` characters, spaces aside."""
    x, y = re.sub(r"\s+", "", a or ""), re.sub(r"\s+", "", b or "")
    if not x or not y:
        return False
    grams = {x[k : k + common] for k in range(len(x) - common + 1)}
    return x in y or y in x or any(y[k : k + common] in grams for k in range(len(y) - common + 1))


def segment_consensus(checks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, project, verdict, conflict, segments, reported): checks of a sample grouped by project, first match wins.

    Rows need item, verdict, reported, evidenced, segment.  Evidenced rows count alone if there are any; pass and
    fail together are manual_review.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        groups: list[tuple[str, list]] = []
        for row in rows:
            key = project_key(row[0])
            own = next((g for g in groups if same_project(g[0], key)), None)
            if own is None:
                groups.append((key, [row]))
            else:
                own[1].append(row)
        out = []
        for _, own in groups:
            own = [r for r in own if r[3]] or own
            conflict = {"pass", "fail"} <= {r[1] for r in own}
            texts = list(dict.fromkeys(r[2] for r in own if r[2]))
            out.append((own[0][0], "manual_review" if conflict else own[0][1], conflict, sorted({int(r[4]) for r in own}), "；".join(texts)))
        return out

    result = [T.StructField("project", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("conflict", T.BooleanType()), T.StructField("segments", T.ArrayType(T.LongType())), T.StructField("reported", T.StringType())]
    return fold_groups(checks, keys, order, ["item", "verdict", "reported", "evidenced", "segment"], fold, result)


def conclusions(checks: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """(key, must_fix, review): what a report has to correct or to look at, each matter counted once.

    Checks (key, pos, item, verdict) take, in order, all findings (key, pos, item, severity, action_required) that
    match them and are still free; what is left counts by its severity.
    """

    def count(rows: list[tuple]) -> list[tuple]:
        free = [(item, severity) for is_finding, item, severity, required in rows if is_finding and required is not False]
        fix = review = 0
        for is_finding, item, verdict, _ in rows:
            if is_finding or verdict not in ("fail", "manual_review"):
                continue
            wanted = ("must_fix",) if verdict == "fail" else ("must_fix", "suggestion")
            free = [f for f in free if not (f[1] in wanted and labels_match(f[0], item))]
            fix, review = fix + (verdict == "fail"), review + (verdict != "fail")
        fix += sum(s == "must_fix" for _, s in free)
        review += sum(s == "suggestion" for _, s in free)
        return [(fix, review)]

    both = checks.select(key, "pos", F.lit(False).alias("is_finding"), "item", F.col("verdict").alias("label"), F.lit(None).cast("boolean").alias("required")).unionByName(
        findings.select(key, "pos", F.lit(True).alias("is_finding"), "item", F.col("severity").alias("label"), F.col("action_required").alias("required"))
    )
    return fold_groups(both, [key], ["pos"], ["is_finding", "item", "label", "required"], count, [T.StructField("must_fix", T.LongType()), T.StructField("review", T.LongType())])

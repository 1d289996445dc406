"""Checks and findings: rules with verdicts, consensus over segments, coverage, budgets.

Everywhere: missing is not false, a conflict goes to a human (``manual_review``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_state(value: Column, lower: Column, upper: Column, lower_inclusive: Column, upper_inclusive: Column) -> Column:
    """within, exceeds, or unknown (a value or bound missing, bounds crossed, inclusivity not said); decimals compare exactly."""
    kind = "decimal(38,18)"
    v, lo, hi = (x.cast(kind) for x in (value, lower, upper))
    known = v.isNotNull() & lo.isNotNull() & hi.isNotNull() & lower_inclusive.isNotNull() & upper_inclusive.isNotNull() & (lo <= hi)
    outside = (v < lo) | (v > hi) | ((v == lo) & ~lower_inclusive) | ((v == hi) & ~upper_inclusive)
    return F.when(~known | known.isNull(), "unknown").when(outside, "exceeds").otherwise("within")


def guarded_verdict(state: Column, verdict: Column) -> Column:
    """A range never creates a pass: it turns a pass that exceeds to fail, one that can't be checked to manual_review."""
    return F.when((verdict == "pass") & (state == "exceeds"), "fail").when((verdict == "pass") & (state == "unknown"), "manual_review").otherwise(verdict)


def consensus(checks: DataFrame, keys: list[str], verdict: str, evidenced: Column, order: str, segment: str) -> DataFrame:
    """One verdict per project: of the evidenced rows if there are any; pass and fail together are manual_review.

    The base row is the first in order; ``segments`` are those of the rows that count.
    """
    per = checks.withColumn("__e", F.coalesce(evidenced, F.lit(False)))
    has = F.bool_or("__e")
    of = lambda value: F.when(F.col("__e"), value)
    agg = per.groupBy(*keys).agg(
        has.alias("evidence"),
        *[F.bool_or(F.when(cond, F.col(verdict) == v)).alias(f"{name}_{v}") for name, cond in (("e", F.col("__e")), ("a", F.lit(True))) for v in ("pass", "fail")],
        F.min_by(of(F.col(verdict)), of(F.col(order))).alias("e_first"),
        F.min_by(verdict, order).alias("a_first"),
        F.array_sort(F.collect_set(of(F.col(segment)))).alias("e_segments"),
        F.array_sort(F.collect_set(segment)).alias("a_segments"),
    )
    pick = lambda name: F.when(F.col("evidence"), F.col(f"e_{name}")).otherwise(F.col(f"a_{name}"))
    conflict = F.coalesce(pick("pass"), F.lit(False)) & F.coalesce(pick("fail"), F.lit(False))
    return agg.select(*keys, F.when(conflict, "manual_review").otherwise(pick("first")).alias("verdict"), conflict.alias("conflict"), pick("segments").alias("segments"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str], segment: str) -> DataFrame:
    """The first row of each key with the segments that had it."""
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("__r"), F.array_sort(F.collect_set(segment)).alias("segments")).select(*keys, "__r.*", "segments")


def missing_suppressed(findings: DataFrame, checks: DataFrame, on: list[str], is_missing: Column, has_evidence: Column) -> DataFrame:
    """Findings without the claims of something missing for which a check has evidence."""
    evidence = checks.filter(has_evidence).select(*on).distinct()
    claims = findings.filter(F.coalesce(is_missing, F.lit(False)))
    return findings.filter(~F.coalesce(is_missing, F.lit(False))).unionByName(claims.join(evidence, on, "left_anti"))


#: What tells findings apart, and what a conflict between segments says.
FINDING = ("item", "reported", "should_be", "standard", "severity")
CONFLICT = {"item": "分段结论冲突", "reported": "不同分段同时出现符合与不符合结论", "should_be": "核对原始页面和试验数据后人工确认", "standard": "", "severity": "suggestion"}


def merge_policy(findings: DataFrame, checks: DataFrame, rules: DataFrame, code: str, keys: list[str], project: str, segment: str, verdict: str, evidenced: Column, is_missing: Column) -> DataFrame:
    """(keys, FINDING, segments): findings of all segments merged, if the rule ``code`` has an active version of kind merge_policy.

    Then equal findings are one with all its segments, claims of something missing go where a check of their project has
    evidence, and each project that passes and fails gets a finding.  Without such a rule (none, no active version, the
    newest active one of another kind) every finding stays as it is.  Missing fields are empty.
    """
    gate = rules.filter((F.col("code") == code) & (F.col("status") == "active")).agg(F.max_by("kind", F.struct("version", "id")).alias("__kind")).select(F.coalesce(F.col("__kind") == "merge_policy", F.lit(False)).alias("__on"))
    gated = lambda rows, on: rows.crossJoin(gate).filter(F.col("__on") == on).drop("__on")  # noqa: E731  # one row
    fields = [F.coalesce(c, F.lit("")).alias(c) for c in FINDING]
    kept = missing_suppressed(gated(findings, True), gated(checks, True), [*keys, project], is_missing, evidenced)
    merged = kept.select(*keys, *fields, segment).groupBy(*keys, *FINDING).agg(F.array_sort(F.collect_set(segment)).alias("segments"))
    agreed = consensus(gated(checks, True), [*keys, project], verdict, evidenced, segment, segment).filter("conflict")
    conflicts = agreed.select(*keys, *[(F.concat(project, F.lit(v)) if c == "item" else F.lit(v)).alias(c) for c, v in CONFLICT.items()], "segments")
    return merged.unionByName(conflicts).unionByName(gated(findings, False).select(*keys, *fields, F.array(segment).alias("segments")))


def budget(rows: DataFrame, keys: list[str], order: str, is_pass: Column, limit: int) -> DataFrame:
    """All rows that are not passes, and the first passes that the budget leaves room for."""
    w = Window.partitionBy(*keys)
    df = rows.withColumn("__p", F.coalesce(is_pass, F.lit(False)))
    room = F.greatest(F.lit(limit) - F.count_if(~F.col("__p")).over(w), F.lit(0))
    taken = F.count_if("__p").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    small = F.count("*").over(w) <= limit
    return df.withColumns({"__room": room, "__taken": taken, "__small": small}).filter(~F.col("__p") | F.col("__small") | (F.col("__taken") <= F.col("__room"))).drop("__p", "__room", "__taken", "__small")


def roll_up(rows: DataFrame, keys: list[str], verdict: str) -> DataFrame:
    """Any fail is fail; else any verdict that is neither pass nor fail, or missing, is manual_review; else pass."""
    fail = F.coalesce(F.bool_or(F.col(verdict) == "fail"), F.lit(False))
    unknown = F.bool_or(~F.coalesce(F.col(verdict), F.lit("")).isin("pass", "fail"))
    return rows.groupBy(*keys).agg(F.when(fail, "fail").when(unknown, "manual_review").otherwise("pass").alias("verdict"), F.count("*").alias("fields"))


def coverage(required: DataFrame, evidence: DataFrame, on: list[str], condition: Column) -> DataFrame:
    """Required and conditional items with an outcome: covered, missing, not_applicable or unknown.

    ``condition`` is a nullable boolean; required items have it true.
    """
    seen = evidence.select(*on).distinct().withColumn("__seen", F.lit(True))
    outcome = F.when(F.col("__seen"), "covered").when(condition.isNull(), "unknown").when(~condition, "not_applicable").otherwise("missing")
    return required.join(seen, on, "left").withColumn("outcome", outcome).drop("__seen")


def coverage_counts(covered: DataFrame, by: list[str]) -> DataFrame:
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return covered.groupBy(*by).agg(F.count("*").alias("total"), *map(count, ("covered", "missing", "not_applicable", "unknown")))


def input_guard(claims: DataFrame, available: DataFrame, sample: str, needs: str) -> DataFrame:
    """Claims with the inputs their rule needs and the sample lacks; a claim stands only if it lacks none."""
    need = claims.select("claim_id", sample, F.explode(needs).alias("input"))
    lacking = need.join(available.select(sample, "input").distinct(), [sample, "input"], "left_anti")
    per = lacking.groupBy("claim_id").agg(F.array_sort(F.collect_set("input")).alias("lacking"))
    return claims.join(per, "claim_id", "left").withColumn("stands", F.col("lacking").isNull())


def change_rates(before: Column, after: Column) -> Column:
    """Relative changes of two arrays in whole per cent, half away from zero; NULL where it can't be computed."""
    return F.zip_with(before, after, lambda b, a: F.when(b > 0, F.round((a / b - 1) * 100)))


def mismatched_columns(calculated: Column, reported: Column) -> Column:
    """1-based places where a reported value differs from the calculated one."""
    both = F.zip_with(calculated, reported, lambda c, r: F.coalesce(c != r, F.lit(False)))
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(both), F.lit(1))), lambda i: F.get(both, i - 1))


def minimum_thickness(nominal: Column, factor: float) -> Column:
    """nominal * factor - 0.1, two decimals."""
    return F.round(nominal * factor - 0.1 + 1e-9, 2)


def inside_any(value: Column, intervals: Column) -> Column:
    """Inside one of the permitted (lo, hi) intervals."""
    return F.exists(intervals, lambda i: (value >= i["lo"]) & (value <= i["hi"]))


def chronology(received: Column, completed: Column, issued: Column) -> Column:
    """Date arrays in order: pass; several or no readings ambiguous; out of order manual_review."""
    single = lambda a: F.when(F.size(F.array_distinct(a)) == 1, a[0])
    r, c, i = single(received), single(completed), single(issued)
    return F.when(r.isNull() | c.isNull() | i.isNull(), "ambiguous").when((r <= c) & (c <= i), "pass").otherwise("manual_review")


def consistent_actions(checks: DataFrame, findings: DataFrame, on: list[str]) -> DataFrame:
    """A fail needs an open action; a pass with one becomes manual_review, its old verdict kept."""
    open_actions = findings.filter("action_required").select(*on).distinct().withColumn("__open", F.lit(True))
    df = checks.join(open_actions, on, "left")
    odd = ((F.col("verdict") == "pass") & F.col("__open").isNotNull()) | ((F.col("verdict") == "fail") & F.col("__open").isNull())
    return df.withColumns({"prior_verdict": F.when(odd, F.col("verdict")), "verdict": F.when(odd, "manual_review").otherwise(F.col("verdict"))}).drop("__open")


def withdrawn_absences(findings: DataFrame, conditions: DataFrame, on: list[str]) -> DataFrame:
    """Findings without absence-only claims whose condition is known to be false; failed tests always stay."""
    false = conditions.filter("state = false").select(*on).distinct()
    absent = findings.filter("absence_only and not failed")
    return findings.filter("not (absence_only and not failed)").unionByName(absent.join(false, on, "left_anti"))


def hierarchy_consistent(values: Column) -> Column:
    """Whether report numbers are one number and its numbered parts: ``ABCD123456S``, ``ABCD1234561S``.

    All end in one letter; without it they share a prefix of eight or more, and what follows is one to three
    digits (or nothing, for the number itself), not the same for all.
    """
    ends = F.array_distinct(F.transform(values, lambda v: F.right(v, F.lit(1))))
    bodies = F.transform(values, lambda v: F.substr(v, F.lit(1), F.length(v) - 1))
    shortest = F.array_min(F.transform(bodies, lambda b: F.length(b)))
    base = F.element_at(F.array_sort(F.filter(bodies, lambda b: F.length(b) == shortest)), 1)
    parts = F.forall(bodies, lambda b: F.startswith(b, base) & F.regexp_like(F.substr(b, F.length(base) + 1), F.lit(r"^[0-9]{0,3}$")))
    letter = F.regexp_like(ends[0], F.lit("^[A-Z]$"))
    return F.coalesce((F.size(F.array_distinct(values)) > 1) & (F.size(ends) == 1) & letter & (F.length(base) >= 8) & parts, F.lit(False))

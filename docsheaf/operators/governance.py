"""Master data and rule versions: validation of writes, permissions, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validated_upsert(new: DataFrame, existing: DataFrame, key: str, name: str, status: str, source: str) -> DataFrame:
    """New and changed master rows with why they are rejected, and what changes.

    A name must not be blank nor used by another row; a status other than unknown needs a source, unknown clears it.
    """
    clean = F.trim(name)
    df = new.withColumn(name, clean)
    used = existing.select(F.col(key).alias("__other"), F.col(name).alias("__name")).groupBy("__name").agg(F.min("__other").alias("__low"), F.max("__other").alias("__high"))
    old = existing.select(key, F.col(status).alias("__old"))
    df = df.join(used, df[name] == used["__name"], "left").join(old, key, "left")
    taken = F.col("__low").isNotNull() & ((F.col("__low") != F.col(key)) | (F.col("__high") != F.col(key)))
    no_source = (F.coalesce(status, F.lit("unknown")) != "unknown") & (F.coalesce(F.trim(source), F.lit("")) == "")
    reason = F.when(F.coalesce(F.col(name), F.lit("")) == "", "blank_name").when(taken, "name_taken").when(no_source, "no_source")
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__old") != F.col(status), "update").otherwise("keep")
    return df.select(key, name, F.coalesce(status, F.lit("unknown")).alias(status), F.when(F.col(status) != "unknown", F.col(source)).alias(source), reason.alias("reason"), action.alias("action"))


def permission_errors(wanted: Column, valid: list[str], forbidden: list[str], needs: dict[str, str]) -> Column:
    """Errors of a set of permissions: unknown ones, forbidden ones, and prerequisites that are missing."""
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    checks = [F.when(F.size(F.array_except(wanted, lit(valid))) > 0, F.lit("unknown")), F.when(F.arrays_overlap(wanted, lit(forbidden)), F.lit("forbidden"))]
    checks += [F.when(F.array_contains(wanted, p) & ~F.array_contains(wanted, n), F.lit(f"{p} needs {n}")) for p, n in needs.items()]
    return F.array_compact(F.array(*checks))


def verification_reasons(results: DataFrame, tasks: DataFrame, name_key) -> DataFrame:
    """Answers of a registry, joined to their tasks, with why they fail: name, status or host; NULL if none."""
    df = results.join(tasks, "task_id")
    reason = F.when(~name_key("name").eqNullSafe(name_key("expected_name")), "name_differs").when(F.coalesce(F.trim("raw_status"), F.lit("")) == "", "no_status").when(~F.col("host_ok"), "host_not_allowed")
    return df.withColumn("reason", reason)


def snapshot(rules: DataFrame, wanted: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """The rules of a new immutable version, and wanted ids that are unknown or retired; publish only if there are none."""
    usable = rules.filter("status <> 'retired'")
    return wanted.join(usable, "id").withColumn("version_no", F.lit(version)), wanted.join(usable, "id", "left_anti")


def rule_text(fields: Column) -> Column:
    """``key=value`` pairs of a map that are not blank, by key."""
    pairs = F.array_sort(F.transform(F.filter(F.map_entries(fields), lambda e: F.trim(e["value"]) != ""), lambda e: F.concat(e["key"], F.lit("="), F.trim(e["value"]))))
    return F.array_join(pairs, "; ")


def active_context(rules: DataFrame, family: str, markers: dict[str, str]) -> DataFrame:
    """One text of the rules that fit a family: those that name it, and those that name none."""
    text = F.concat_ws(" ", "title", "rule_text")
    own = F.regexp_like(text, F.lit(markers[family]))
    others = F.lit(False)
    for name, pattern in markers.items():
        if name != family:
            others = others | F.regexp_like(text, F.lit(pattern))
    lines = F.array_sort(F.collect_list(F.struct("id", text.alias("t"))))
    return rules.filter(own | ~others).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("context"))

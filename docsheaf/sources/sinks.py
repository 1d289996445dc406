"""Writers: CSV exports, versioned results, audit logs, Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failure_reason(conclusion: Column, findings: Column, remarks: Column, status: Column, error: Column, detail: Column) -> Column:
    """One text per report: none for a pass, else its findings, the error of a failed run, remarks, or detail."""
    text = F.nullif(F.array_join(F.array_compact(findings), "；"), F.lit(""))
    return F.when(conclusion == "pass", F.lit("无")).otherwise(F.coalesce(text, F.when(status == "failed", error), F.nullif(F.trim(remarks), F.lit("")), F.nullif(F.trim(detail), F.lit("")), F.lit("")))


def write_csv(df: DataFrame, path: str, nulls: str = "") -> None:
    """RFC quoting (quotes doubled, line breaks kept) with a header."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(nulls)).alias(c) for c in df.columns]).write.option("header", True).option("escape", '"').option("emptyValue", nulls).csv(path)


def append_versions(versions: DataFrame, findings: DataFrame, path: str) -> None:
    """Appends result versions; replaces the findings of just the reports that have a new one."""
    versions.write.mode("append").parquet(f"{path}/versions")
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_id").parquet(f"{path}/findings")


def audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def markdown(checks: DataFrame, key: str, order: str, findings: DataFrame | None = None) -> DataFrame:
    """(key, text): a table line per check, in order; then a list line per finding, where there are any."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    listed = lambda line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]), "\n")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, ("item", "reported", "required", "verdict"))), F.lit(" |"))
    table = checks.groupBy(key).agg(F.concat(F.lit("| item | reported | required | verdict |\n|---|---|---|---|\n"), listed(row)).alias("text"))
    if findings is None:
        return table
    found = findings.groupBy(key).agg(listed(F.concat(F.lit("- "), F.concat_ws(": ", *map(cell, ("item", "should_be"))))).alias("__found"))
    return table.join(found, key, "left").select(key, F.concat_ws("\n\n", "text", "__found").alias("text"))

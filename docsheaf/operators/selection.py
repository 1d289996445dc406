"""Which rows stay: searches, governance, whitelists, suppressed findings, checked payloads.

What removes rows returns them too, with the reason, so nothing vanishes silently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsheaf.functions import reports as R

# Scopes and results that a content review may return, and terms of test contents that it may not.
REVIEW_SCOPES, REVIEW_RESULTS = ("report_identifier", "date_logic", "equipment_list", "document_structure", "sample_identity"), ("warning", "manual_review")
TEST_TERMS = (
    "抗张", "断裂伸长", "变化率", "修约", "最薄处", "椭圆度", "耐擦", "失重", "热冲击", "低温弯曲", "低温拉伸", "高温压力", "热稳定",
    "标准要求", "实测值", "检验结果", "单项评定", "判p", "判n", "判f", "p判定", "n判定", "f判定",
)
# What a finding that is not required but passed says.
NOT_REQUIRED, PASSED = r"(?i)(?:\bN\b|不适用|不要求|未列)", r"(?i)(?:(?:^|[^A-Z])P(?:$|[^A-Z])|合格|通过|无裂纹|未击穿)"


def in_json_array(values: str | Column, query: str) -> Column:
    """Whether an array, written as JSON text, holds the query anywhere, in any case."""
    return F.contains(F.lower(F.to_json(values)), F.lit(query.lower()))


def has_item(values: str | Column, query: str) -> Column:
    """Whether some item of an array holds the query, in any case."""
    return F.exists(values, lambda v: F.contains(F.lower(v), F.lit(query.lower())))


def governed(df: DataFrame, verified: str = "verification_status", enabled: str = "enabled_for_review") -> DataFrame:
    """Rows that are verified and enabled; a table without such a column keeps all of them."""
    ok = F.lit(True)
    if verified in df.columns:
        ok = ok & F.coalesce(F.lower(F.col(verified).cast("string")) == "verified", F.lit(False))
    if enabled in df.columns:
        ok = ok & F.coalesce(F.lower(F.col(enabled).cast("string")) == "true", F.lit(False))
    return df.filter(ok)


def whitelisted(entries: DataFrame, fields: Sequence[str], allowed: str, forbidden: str, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): an entry stays if its fields show an allowed term and no forbidden one."""
    scope = F.concat_ws(" ", *fields)
    keep = F.regexp_like(scope, F.lit(allowed)) & ~F.regexp_like(scope, F.lit(forbidden))
    return entries.filter(keep), entries.filter(~keep).withColumn("item", F.left("item", F.lit(most)))


def extra_passed(findings: DataFrame) -> DataFrame:
    """Findings (item, reported, should_be, standard) with ``extra``: not required, yet done and passed; cold tests never."""
    said = F.concat_ws(" ", "reported", "should_be", "standard")
    return findings.withColumn("extra", ~F.contains(R.text_of("item"), F.lit("低温")) & F.regexp_like(said, F.lit(NOT_REQUIRED)) & F.regexp_like(R.text_of("reported"), F.lit(PASSED)))


def without_extra_passed(findings: DataFrame, checks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(findings, checks) without the extra ones; the checks that they belong to pass, with a note.

    A check belongs to a finding of its sample if one's words contain the other's; ``checks`` has an ``id``.
    """
    marked = extra_passed(findings)
    plain = lambda *c: F.regexp_replace(F.concat_ws("", *c), r"(?U)\W+", "")
    gone = marked.filter("extra").select(*keys, plain("item").alias("__label")).filter("__label <> ''").distinct()
    own = checks.withColumn("__own", plain("category", "item"))
    hit = own.join(gone, keys).filter(F.contains("__own", F.col("__label")) | F.contains("__label", F.col("__own"))).select("id").distinct().withColumn("__hit", F.lit(True))
    note = F.lit("标准未要求但报告加做且结果合格，不构成修改或人工复核项")
    flipped = own.join(hit, "id", "left").withColumns({"verdict": F.when(F.col("__hit"), "pass").otherwise(F.col("verdict")), "note": F.when(F.col("__hit"), note).otherwise(F.col("note"))})
    return marked.filter("not extra").drop("extra"), flipped.select(*checks.columns)


def suppressed(rows: DataFrame, reasons: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept, log): the first reason whose condition holds takes a row out and stands beside it in the log."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in reasons], F.lit(None).cast("string"))
    df = rows.withColumn("reason", reason)
    return df.filter("reason is null").drop("reason"), df.filter("reason is not null")


def personnel_signature(item: Column, note: Column) -> Column:
    """Checks of who signed: handwriting is no evidence."""
    text = F.concat_ws(" ", item, note)
    says = lambda p: F.regexp_like(text, F.lit(p))
    return says("签名|签字|手写|姓名") & (says("审核人|签名人|批准人|编制人|检验人|人员") | says("一致|不一致|不符|相符|核对|确认|识别"))


def reviewed_payloads(payloads: DataFrame, key: str, payload: str, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(checks, errors) of JSON payloads ``{"logic_checks": [{scope, item, result, note}]}``.

    A payload of another shape, or with a scope or result outside the domain, is an error as a whole; checks that
    tell contents of tests are dropped; of the rest the first ``most`` stay.
    """
    parsed = F.from_json(F.col(payload), "logic_checks array<struct<scope:string,item:string,result:string,note:string>>", {"mode": "PERMISSIVE"})
    keys = F.array_sort(F.json_object_keys(payload))
    rows = payloads.withColumn("__c", parsed["logic_checks"]).withColumn("__k", keys)
    clean = lambda c: F.lower(F.trim(c))
    whole = lambda x: x["scope"].isNotNull() & x["item"].isNotNull() & x["result"].isNotNull() & x["note"].isNotNull()
    error = (
        F.when(F.col("__c").isNull() | ~F.coalesce(F.col("__k") == F.array(F.lit("logic_checks")), F.lit(False)), "shape")
        .when(~F.forall("__c", whole), "fields")
        .when(~F.forall("__c", lambda x: clean(x["scope"]).isin(*REVIEW_SCOPES)), "scope")
        .when(~F.forall("__c", lambda x: clean(x["result"]).isin(*REVIEW_RESULTS)), "result")
    )
    rows = rows.withColumn("error", error)
    told = lambda x: F.regexp_like(F.lower(F.concat_ws(" ", x["item"], x["note"])), F.lit("|".join(TEST_TERMS)))
    checks = rows.filter("error is null").select(key, F.posexplode(F.slice(F.filter("__c", lambda x: ~told(x)), 1, most)).alias("pos", "c"))
    out = checks.select(key, "pos", clean(F.col("c.scope")).alias("scope"), F.coalesce(F.nullif(F.left(F.trim("c.item"), F.lit(80)), F.lit("")), F.lit("逻辑一致性")).alias("item"), clean(F.col("c.result")).alias("result"), F.left(F.trim("c.note"), F.lit(300)).alias("note"))
    return out, rows.filter("error is not null").select(key, "error")


def ordered_by_name(df: DataFrame, name: str, key: str) -> DataFrame:
    """Case-insensitive order, equal names by key."""
    return df.orderBy(F.lower(name), key)


def capped(df: DataFrame, keys: list[str], order: Sequence[Column], most: int = 60) -> DataFrame:
    """The first ``most`` rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)


def capped_text(text: Column, most: int = 14_000, note: str = "\n（结构化规则摘要已按长度上限截断）") -> Column:
    """A context of at most ``most`` characters; a longer one is cut and says so."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(note))).otherwise(text)


def next_revisions(new: DataFrame, existing: DataFrame, application: str, revision: str, key: str) -> DataFrame:
    """New reports with the report of their application that they would follow, and the next revision number."""
    last = existing.groupBy(application).agg(F.max(F.struct(revision, key)).alias("__last"))
    df = new.join(last, application, "left")
    return df.withColumn("follows", F.col(f"__last.{key}")).withColumn("next_revision", F.coalesce(F.col(f"__last.{revision}") + 1, F.lit(0))).drop("__last")


def valid_cache(df: DataFrame) -> Column:
    """Whether an earlier preflight result may be used again: enforced, complete, nothing found, nothing blocked, texts there."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    ok = (F.col("mode") == "enforce") & F.col("model_status").isin("ok", "disabled") & (F.size("outbound_findings") == 0) & ~F.col("outbound_blocked")
    counts = F.coalesce(F.forall(F.map_values("replacement_counts"), lambda n: n >= 0), F.lit(False)) & F.map_contains_key("replacement_counts", "company") & F.map_contains_key("replacement_counts", "application_no")
    return F.coalesce(ok & filled("external_text") & filled("sanitized_text") & counts, F.lit(False))


def issue_count(samples: str | Column, severities: Sequence[str] = ("must_fix", "suggestion")) -> Column:
    """Findings of the severities in nested samples (array of struct with ``items``)."""
    return F.aggregate(samples, F.lit(0), lambda n, s: n + F.size(F.filter(F.coalesce(s["items"], F.array()), lambda i: i["severity"].isin(*severities))))


def status_counts(df: DataFrame, keys: list[str], status: str, domain: Sequence[str]) -> DataFrame:
    """Rows per key and status of a fixed domain, and those of any other status."""
    other = F.count_if(~F.coalesce(F.col(status).isin(*domain), F.lit(False))).alias("other")
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == s).alias(s) for s in domain], other)


def batch_totals(batches: DataFrame, keys: list[str], sums: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Per report: batches, sums of their numbers, and how many have each flag."""
    return batches.groupBy(*keys).agg(F.count("*").alias("batches"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums], *[F.count_if(F.col(c)).alias(c) for c in flags])

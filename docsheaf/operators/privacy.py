"""Release checks: find, redact, scan again, record the decision.

Patterns are (type, regular expression, placeholder) rows, so a deployment brings its own; the ones
here serve the queries.  A scan tells types and reasons, never the matched text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    placeholder: str
    #: A string that each match holds; texts without it are not searched.
    holds: str = ""

    def within(self, text: Column, found: Column, otherwise: Column) -> Column:
        return F.when(F.contains(text, F.lit(self.holds)), found).otherwise(otherwise) if self.holds else found


#: Forms of application numbers and company names, with their placeholders.
APPLICATION = Pattern("application_no", r"(?i)(?<![A-Z0-9])A\s*\d{4}\s*CCC(?:\s*[-_/]?\s*[A-Z0-9]){5,}(?![A-Z0-9])", "[申请编号已脱敏]")
COMPANY = Pattern("company", r"(?<!\[)([一-鿿A-Za-z0-9（）()·]{2,60}(?:股份有限公司|有限责任公司|有限公司|集团公司|研究院|研究所|检测中心|认证中心|公司))", "[企业名称已脱敏]")
# A local part is only tried where its run of characters begins, or where the last match ended: long runs cost no more.
EMAIL = Pattern("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[email]", "@")
SECRET = Pattern("secret", r"token = \"[0-9a-f]{40}\"", "[secret]", 'token = "')
DEFAULT = (EMAIL, SECRET)
REPORT = (APPLICATION, COMPANY)


def detected(text: Column, patterns: Sequence[Pattern] = DEFAULT, shortest: int = 3) -> Column:
    """Sorted distinct values of all patterns, spaces removed, very short ones left out."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)) for p in patterns]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda v: F.regexp_replace(v, r"(?U)\s+", "")), lambda v: F.length(v) >= shortest)))


def redacted(text: Column, patterns: Sequence[Pattern] = DEFAULT, known: Column | None = None, placeholder: str = "[known]") -> Column:
    """The text with known values (longest first), then patterns, replaced."""
    if known is not None:
        longest = F.array_sort(known, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
        text = F.aggregate(longest, text, lambda acc, v: F.replace(acc, v, F.lit(placeholder)))
    for p in patterns:
        text = p.within(text, F.regexp_replace(text, p.regex, p.placeholder.replace("$", r"\$")), text)
    return text


def counts(text: Column, patterns: Sequence[Pattern] = DEFAULT) -> dict[str, Column]:
    return {f"n_{p.kind}": p.within(text, F.regexp_count(text, F.lit(p.regex)), F.lit(0)) for p in patterns}


def residual(text: Column, patterns: Sequence[Pattern] = DEFAULT) -> Column:
    """Types that a text still shows."""
    return F.array_compact(F.array(*[F.when(p.within(text, F.regexp_like(text, F.lit(p.regex)), F.lit(False)), F.lit(p.kind)) for p in patterns]))


def released(docs: DataFrame, text: str = "text", patterns: Sequence[Pattern] = DEFAULT) -> DataFrame:
    """Redacts, scans again and decides: text (NULL where blocked), findings, released, and the guard record."""
    clean = redacted(F.coalesce(F.col(text), F.lit("")), patterns)
    df = docs.withColumns(counts(F.coalesce(F.col(text), F.lit("")), patterns)).withColumn("__clean", clean).withColumn("findings", residual(F.col("__clean"), patterns))
    ok = F.size("findings") == 0
    return df.withColumns({"released": ok, "sha256": F.sha2("__clean", 256), "size": F.length("__clean"), text: F.when(ok, F.col("__clean"))}).drop("__clean")


def preflight(docs: DataFrame, text: str, identifiers: dict[str, str], patterns: Sequence[Pattern] = DEFAULT) -> DataFrame:
    """Checks that each kind of identifier is one throughout, appends what is not, redacts all of it, and scans what would go out.

    Adds logic_checks (item, result, note), findings, blocked, and text as it may go out: NULL where it is blocked.
    """
    own = F.coalesce(F.col(text), F.lit(""))

    def check(item: str, pattern: str) -> Column:
        ids = F.array_distinct(F.transform(F.regexp_extract_all(own, F.lit(pattern), F.lit(0)), lambda v: F.upper(F.regexp_replace(v, r"[\s/_-]+", ""))))
        one = F.size(ids) == 1
        return F.when(F.size(ids) > 0, F.struct(F.lit(item).alias("item"), F.when(one, "pass").otherwise("warning").alias("result"), F.when(one, "一致").otherwise("识别到多个不同编号，需人工核对").alias("note")))

    df = docs.withColumn("logic_checks", F.array_compact(F.array(*[check(i, p) for i, p in identifiers.items()])))
    told = F.array_join(F.transform(F.filter("logic_checks", lambda c: c["result"] != "pass"), lambda c: F.concat_ws(": ", c["item"], c["note"])), "；")
    df = df.withColumn("__clean", redacted(F.concat_ws("\n", own, F.nullif(told, F.lit(""))), patterns)).withColumn("findings", residual(F.col("__clean"), patterns))
    return df.withColumn("blocked", F.size("findings") > 0).withColumn(text, F.when(~F.col("blocked"), F.col("__clean"))).drop("__clean")


def id_consistency(rows: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """Per key: whether all identifiers found are one after normalisation; keys without any are absent."""
    ids = rows.select(*keys, F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))).alias("id"))
    norm = F.upper(F.regexp_replace("id", r"[\s/_-]+", ""))
    per = ids.groupBy(*keys).agg(F.count_distinct(norm).alias("n_ids"), F.min(norm).alias("first_id"))
    return per.withColumn("result", F.when(F.col("n_ids") == 1, "pass").otherwise("warning"))


def not_yet_done(rows: DataFrame, done: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Rows whose fingerprint has no valid earlier result."""
    valid = done.filter("status = 'ok' and findings = 0 and length(text) > 0") if {"status", "findings", "text"} <= set(done.columns) else done
    return rows.join(valid.select(fingerprint).distinct(), fingerprint, "left_anti")


def actionable_summary(checks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One text per key of its checks that are not passes."""
    line = F.concat_ws(": ", "item", "note")
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return checks.filter("result <> 'pass'").groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["t"]), "；").alias("summary"))

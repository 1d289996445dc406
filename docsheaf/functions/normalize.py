"""Scalar normalisers and strict parsers as Column functions.

All are fail-closed: what does not match completely is NULL, never a repaired guess.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are folded, in and out position by position.
_FOLD_FROM, _FOLD_TO = "‐‑‒–—―−～〜＊×＋／", "-------~~**+/"
_ASCII = r"^[\x00-\x7F]*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    import unicodedata

    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def folded(c: str | Column) -> Column:
    """NFKC, then dashes, tildes, stars, plus and slash folded, trimmed; only non-ASCII rows reach Python."""
    c = col(c)
    return F.trim(F.translate(F.when(c.rlike(_ASCII), c).otherwise(_nfkc(F.when(~c.rlike(_ASCII), c))), _FOLD_FROM, _FOLD_TO))


def key(c: str | Column) -> Column:
    """Upper case without any white space."""
    return F.upper(F.regexp_replace(col(c), r"(?U)\s+", ""))


def model_code(c: str | Column) -> Column:
    """Full-width brackets and spacing folded, ``IEC 60227`` kept as one prefix form."""
    text = F.translate(F.upper(F.trim(col(c))), "（）－　", "()- ")
    return F.regexp_replace(F.regexp_replace(text, r"\s*([()/-])\s*", "$1"), r"\s+", " ")


def without_category_prefix(c: str | Column) -> Column:
    """Without an optional ``ZA-`` to ``ZD-`` prefix."""
    return F.regexp_replace(col(c), r"^Z[A-D]-", "")


def company_key(c: str | Column) -> Column:
    """Spaces removed, brackets full-width."""
    return F.translate(F.regexp_replace(col(c), r"(?U)\s+", ""), "()", "（）")


def identifier_key(c: str | Column) -> Column:
    """Letters and digits only, upper case."""
    return F.regexp_replace(F.upper(col(c)), r"[^A-Z0-9]", "")


def strict_number(c: str | Column, unit: str = r"(?:mm(?:²|2)?|毫米)?") -> Column:
    """A whole text that is one plain number with at most the unit; else NULL."""
    c = col(c).cast("string")
    return F.regexp_extract(F.when(c.rlike(rf"(?i)^\s*-?\d+(?:\.\d+)?\s*{unit}\s*$"), c), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def positive_number(c: str | Column) -> Column:
    n = strict_number(c)
    return F.when(n > 0, n)


def strict_boolean(c: str | Column) -> Column:
    v = F.lower(F.trim(col(c).cast("string")))
    return F.when(v.isin("true", "yes", "1", "是"), F.lit(True)).when(v.isin("false", "no", "0", "否"), F.lit(False))


def json_object(c: str | Column) -> Column:
    """The JSON object as a string map; an empty map where it is none."""
    return F.coalesce(F.from_json(F.when(col(c).rlike(r"^\s*\{"), col(c)), "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def first_value(*cols: str | Column) -> Column:
    """The first that is not blank, trimmed; an empty string if none."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in cols], F.lit(""))


def ordered_category(c: str | Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first category of which a keyword occurs in the text."""
    text = F.coalesce(col(c), F.lit(""))
    out = F.lit(default)
    for category, words in reversed(list(rules)):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, F.lit(category)).otherwise(out)
    return out


#: Status words in order of precedence, and the categories of findings.
STATUS_RULES = (("revoked", ("吊销",)), ("cancelled", ("注销", "已注销", "清算", "清算中")), ("moved", ("迁出",)), ("active", ("存续", "在业", "开业", "正常", "营业", "迁入")))
FINDING_CATEGORIES = (
    ("标识问题", ("标识", "标志", "标记", "印字", "字迹")),
    ("结构尺寸问题", ("结构", "尺寸", "外径", "厚度", "护套", "节距", "绞合")),
    ("电气性能问题", ("电阻", "电压", "耐压", "绝缘电阻", "导体电阻", "电气", "击穿")),
    ("机械性能问题", ("拉伸", "断裂", "伸长率", "抗张", "老化", "机械")),
    ("燃烧问题", ("燃烧", "阻燃", "耐火", "烟密度", "卤酸")),
)


def operating_status(c: str | Column) -> Column:
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", "")
    return F.when(text == "", F.lit("unknown")).otherwise(ordered_category(text, STATUS_RULES, "other"))


def finding_category(c: str | Column) -> Column:
    return ordered_category(c, FINDING_CATEGORIES, "其他问题")


def keyword_score(c: str | Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the keywords that occur."""
    text, total = F.coalesce(col(c), F.lit("")), F.lit(0.0)
    for word, weight in weights.items():
        total = total + F.when(F.contains(text, F.lit(word)), weight).otherwise(0.0)
    return total


def labelled_field(c: str | Column, labels: Sequence[str], pattern: str, stop: Sequence[str] = ()) -> Column:
    """The first match of pattern behind the first label that has one; stop values are skipped."""
    found = [F.nullif(F.trim(F.regexp_extract(col(c), rf"{label}\s*[:：]?\s*({pattern})", 1)), F.lit("")) for label in labels]
    return F.coalesce(*[F.when(~f.isin(list(stop)), f) if stop else f for f in found])


def distinct_matches(c: str | Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), F.lit(group)))


def single(values: Column) -> Column:
    """The only item of an array; NULL if it has none or several."""
    return F.when(F.size(values) == 1, values[0])


def display_interval(token: str | Column) -> Column:
    """What a displayed number may stand for: its value plus and minus half of its last digit."""
    t = F.trim(col(token).cast("string"))
    decimals = F.when(F.contains(t, F.lit(".")), F.length(F.substring_index(t, ".", -1))).otherwise(0)
    half = F.pow(F.lit(10.0), -decimals) / 2
    value = t.try_cast("double")
    return F.struct((value - half).alias("lo"), (value + half).alias("hi"))


def display_change_overlap(before: str | Column, after: str | Column, reported: str | Column) -> Column:
    """Whether a reported relative change (per cent) can follow from displayed values before and after."""
    b, a, r = display_interval(before), display_interval(after), display_interval(reported)
    lo, hi = (a["lo"] / b["hi"] - 1) * 100, (a["hi"] / b["lo"] - 1) * 100
    return (b["lo"] > 0) & (lo <= r["hi"]) & (hi >= r["lo"])


def half_away(c: str | Column, digits: int = 0) -> Column:
    """Rounded half away from zero."""
    return F.round(col(c), digits)


def median_of(values: Column) -> Column:
    """The middle of an array of numbers; of the two middle ones their mean."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2)


def host_allowed(url: str | Column, domains: Sequence[str]) -> Column:
    """Whether the url's host is one of the domains or below one."""
    host, out = F.lower(F.try_parse_url(col(url), F.lit("HOST"))), F.lit(False)
    for d in domains:
        out = out | (host == d) | F.endswith(host, F.lit("." + d))
    return F.coalesce(out, F.lit(False))


def effective_permissions(override: Column, role_default: Column, valid: Column, admin_only: Column, is_admin: Column) -> Column:
    """An override limited to valid permissions, without those for administrators only; else the role's."""
    own = F.array_intersect(F.coalesce(override, role_default), valid)
    return F.array_sort(F.when(is_admin, own).otherwise(F.array_except(own, admin_only)))


def fingerprint(*cols: str) -> Column:
    """SHA-256 of the JSON of the columns, sorted by name."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def stage_percent(low: Column, high: Column, current: Column, total: Column) -> Column:
    """A stage's range of per cent, interpolated and clamped, rounded half to even."""
    share = F.when(total > 0, F.least(F.greatest(current / total, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.bround(low + (high - low) * share).cast("int")


def visible_text(c: str | Column) -> Column:
    """Without tags, the common entities resolved, spaces collapsed."""
    text = F.regexp_replace(col(c), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))

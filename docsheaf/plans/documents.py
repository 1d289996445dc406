"""Queries over documents, pages, conversations and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.functions import normalize as N
from docsheaf.operators import compare, governance, listing, matching, privacy, rulepack, segments, versions
from docsheaf.plans.tables import table
from docsheaf.sources import files

CATEGORIES = (("license", ("Licensed under", "License")), ("secret", ("token = ",)), ("table", (" | ",)), ("shout", ("!!",)))
MARKERS = ("the", "and the", "of the", "license", "apache license", "token", "general public license", "anatouon", "version")
SQL: dict[str, str] = {}


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def _hash():
    return F.sha2(F.encode(_text(), "UTF-8"), 256)


def doc_category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = versions.newest(table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", _hash()).withColumn("category", N.ordered_category("text", CATEGORIES, "prose")).select("doc_id", "h", "category"), ["h"], [F.col("doc_id").desc()])
    return docs.groupBy("category").agg(F.count("*").alias("n"))


SQL["doc_category_distribution"] = """
SELECT category, count(*) AS n FROM (
  SELECT CASE WHEN contains(text, 'Licensed under') OR contains(text, 'License') THEN 'license' WHEN contains(text, 'token = ') THEN 'secret'
              WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout' ELSE 'prose' END AS category
  FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id DESC) = 1) GROUP BY 1"""


def doc_latest_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", _hash().alias("file_hash"))
    return versions.newest_per_hash(docs, "file_hash", "doc_id")


SQL["doc_latest_by_hash"] = "SELECT doc_id, source, sha256(coalesce(text, '')) AS file_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id DESC) = 1"


def duplicate_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions.duplicates(table(spark, sf_dir, "documents").select("doc_id", _hash().alias("h")), F.col("h"), "doc_id")
    return found.filter("doc_id <> existing_id").select("doc_id", "existing_id")


SQL["duplicate_redirect"] = "SELECT doc_id, existing_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS existing_id FROM documents) WHERE doc_id <> existing_id"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(m,) for m in MARKERS], "name string")
    return matching.contained_names(table(spark, sf_dir, "documents").select("doc_id", _text().alias("text")), "doc_id", "text", names, "name")


_HITS = (
    r"WITH names(name) AS (VALUES " + ", ".join(f"('{m}')" for m in MARKERS) + r"), "
    r"docs AS (SELECT doc_id, ' ' || array_to_string(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents), "
    r"hits AS (SELECT doc_id, name FROM docs JOIN names ON contains(t, ' ' || name || ' ')) "
)


def longest_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.longest(_marked(spark, sf_dir), ["doc_id"], "name").select("doc_id", "name")


SQL["longest_name_match"] = _HITS + "SELECT doc_id, name FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) = 1"


def score_band_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _marked(spark, sf_dir).withColumn("score", F.when(F.contains("name", F.lit(" ")), 100).otherwise(F.length("name") + 88).cast("long"))
    return matching.score_band(scored, ["doc_id"], "score", 15, 4, "name").select("doc_id", "name", "score", F.col("rank").cast("long").alias("rank"))


SQL["score_band_topk"] = _HITS + """, s AS (SELECT doc_id, name, (CASE WHEN contains(name, ' ') THEN 100 ELSE length(name) + 88 END)::BIGINT AS score FROM hits),
b AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM s)
SELECT doc_id, name, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS rank FROM b WHERE score >= best - 15
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) <= 4"""


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[c.cast("long").alias(n) for n, c in privacy.counts(_text()).items()], F.sha2(F.encode(privacy.redacted(_text()), "UTF-8"), 256).alias("clean_sha256"))


_MAIL, _SECRET = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r'token = "[0-9a-f]{40}"'
_CLEAN = f"regexp_replace(regexp_replace(coalesce(text, ''), '{_MAIL}', '[email]', 'g'), '{_SECRET}', '[secret]', 'g')"
SQL["redact_text"] = f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_MAIL}'))::BIGINT AS n_email, len(regexp_extract_all(coalesce(text, ''), '{_SECRET}'))::BIGINT AS n_secret, sha256({_CLEAN}) AS clean_sha256 FROM documents"


def residual_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = F.array_join(privacy.residual(_text()), ",")
    return privacy.released(docs.withColumn("before", before)).select("doc_id", "before", F.size("findings").cast("long").alias("left_over"), "released", F.col("size").cast("long").alias("size"), "sha256")


SQL["residual_scan"] = f"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(coalesce(text, ''), '{_MAIL}') THEN 'email' END, CASE WHEN regexp_matches(coalesce(text, ''), '{_SECRET}') THEN 'secret' END) AS before,
(regexp_matches({_CLEAN}, '{_MAIL}')::BIGINT + regexp_matches({_CLEAN}, '{_SECRET}')::BIGINT) AS left_over,
NOT (regexp_matches({_CLEAN}, '{_MAIL}') OR regexp_matches({_CLEAN}, '{_SECRET}')) AS released, length({_CLEAN})::BIGINT AS size, sha256({_CLEAN}) AS sha256 FROM documents"""

_ID = "[A-Z][a-z]{9,}"


def id_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.id_consistency(table(spark, sf_dir, "conversations"), ["conv_id"], "text", _ID)


SQL["id_consistency"] = rf"""SELECT conv_id, count(DISTINCT id) AS n_ids, min(id) AS first_id, CASE WHEN count(DISTINCT id) = 1 THEN 'pass' ELSE 'warning' END AS result
FROM (SELECT conv_id, upper(unnest(regexp_extract_all(coalesce(text, ''), '{_ID}'))) AS id FROM conversations) GROUP BY 1"""


def fingerprint_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.encode(F.concat_ws("|", "lang", _text()), "UTF-8"), 256).alias("fingerprint"))
    return privacy.not_yet_done(docs, docs.filter("lang = 'en' and source < 'src15'")).select("doc_id", "fingerprint")


SQL["fingerprint_incremental"] = "WITH d AS (SELECT doc_id, lang, source, sha256(concat_ws('|', lang, coalesce(text, ''))) AS fingerprint FROM documents) SELECT doc_id, fingerprint FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS o WHERE o.lang = 'en' AND o.source < 'src15' AND o.fingerprint = d.fingerprint)"


def page_lines_first_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return segments.first_marker(pages, "page_id", F.split(F.coalesce("html", F.lit("")), "</p>"), "(?i)<b>|license", 2, 60).withColumn("line_no", F.col("line_no").cast("long"))


SQL["page_lines_first_marker"] = """WITH l AS (SELECT page_id, string_split(coalesce(html, ''), '</p>') AS lines FROM pages),
n AS (SELECT page_id, lines, list_min(list_filter(list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN regexp_matches(lines[i], '(?i)<b>|license') THEN i END), lambda x: x IS NOT NULL)) AS line_no FROM l)
SELECT page_id, line_no, CASE WHEN line_no IS NOT NULL THEN left(array_to_string(list_slice(lines, line_no, line_no + 1), chr(10)), 60) END AS excerpt, line_no IS NOT NULL AS located FROM n"""

_LI, _HREF = r"(?s)<li>(.*?)</li>", r'href="/([^"]*)"'


def list_item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = files.list_records(table(spark, sf_dir, "pages"), "page_id", "html", _LI, r">([^<]{3,})</a>", _HREF)
    return good.withColumn("reason", F.lit("")).unionByName(bad).select("page_id", F.col("pos").cast("long").alias("pos"), "record_id", "link", "reason")


SQL["list_item_records"] = rf"""WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '{_LI}', 1)) AS item, generate_subscripts(regexp_extract_all(html, '{_LI}', 1), 1) - 1 AS pos FROM pages),
r AS (SELECT page_id, pos::BIGINT AS pos, list_distinct(regexp_extract_all(item, '>([^<]{{3,}})</a>', 1)) AS ids, list_distinct(regexp_extract_all(item, '{_HREF}', 1)) AS links FROM i),
m AS (SELECT page_id, pos, ids[1] AS record_id, links[1] AS link, CASE WHEN len(ids) <> 1 THEN 'id' WHEN len(links) <> 1 THEN 'link' END AS reason FROM r)
SELECT page_id, pos, record_id, link, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY page_id, record_id, reason ORDER BY pos) > 1 THEN 'repeated' ELSE '' END) AS reason FROM m"""


def segment_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    cut = segments.sections(turns, ["conv_id"], "turn", F.col("role") == "user")
    return segments.carried(cut, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "asked_at")


SQL["segment_by_flag"] = """SELECT conv_id, turn, role, (sum((role = 'user')::BIGINT) OVER w)::BIGINT AS section, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS asked_at
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.page_coverage(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length(F.coalesce("text", F.lit(""))) > 0, 0)


SQL["page_coverage"] = "SELECT conv_id, count(*) AS pages, max(turn) AS last_page, coalesce(min(turn) = 0 AND max(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AND bool_and(length(coalesce(text, '')) > 0), false) AS complete FROM conversations GROUP BY 1"


def permission_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    errors = governance.permission_errors(F.col("roles"), ["user", "assistant"], ["system"], {"user": "assistant"})
    own = N.effective_permissions(F.col("roles"), F.array(F.lit("user")), F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit("assistant")), F.lit(False))
    return roles.select("conv_id", F.array_join("roles", ",").alias("roles"), F.array_join(errors, ",").alias("errors"), F.array_join(own, ",").alias("effective"))


SQL["permission_sets"] = """WITH r AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS roles FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(roles, ',') AS roles,
concat_ws(',', CASE WHEN len(list_filter(roles, lambda x: x NOT IN ('user', 'assistant'))) > 0 THEN 'unknown' END, CASE WHEN list_contains(roles, 'system') THEN 'forbidden' END,
          CASE WHEN list_contains(roles, 'user') AND NOT list_contains(roles, 'assistant') THEN 'user needs assistant' END) AS errors,
CASE WHEN list_contains(roles, 'user') THEN 'user' ELSE '' END AS effective FROM r"""


def regression_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("expected"))
    results = table(spark, sf_dir, "documents").select("doc_id", F.when(F.length(_text()) >= 400, 1).otherwise(0).alias("actual"))
    return versions.regression(cases, results, "doc_id", {"expected": "actual"}).groupBy("expected").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


SQL["regression_run"] = """SELECT expected, count(*) AS cases, count(*) FILTER (expected IS NOT DISTINCT FROM actual) AS passed, count(*) FILTER (expected IS DISTINCT FROM actual) AS failed
FROM (SELECT doc_id, quality AS expected FROM labels) LEFT JOIN (SELECT doc_id, CASE WHEN length(coalesce(text, '')) >= 400 THEN 1 ELSE 0 END AS actual FROM documents) USING (doc_id) GROUP BY 1"""


def license_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(_text(), "\n")).alias("line_no", "line"))
    templates = [rulepack.Template("license_version", "(?i)version", r"\d+(?:\.\d+)?", unit="version")]
    found = rulepack.extract_measurements(lines, ["doc_id", "line_no"], "line", templates)
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "item", F.size("values").cast("long").alias("n_values"), F.get("values", F.lit(0)).alias("value"), "status")


SQL["license_measurements"] = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
v AS (SELECT doc_id, line_no, regexp_extract_all(regexp_replace(regexp_extract(line, '(?i)(?:version)\s*[:：]?\s*(.*)$', 1), '(?:≥|>=|≤|<=)\s*\d+(?:\.\d+)?', ' ', 'g'), '\d+(?:\.\d+)?') AS vals FROM l WHERE regexp_matches(line, '(?i)version'))
SELECT doc_id, line_no::BIGINT AS line_no, 'license_version' AS item, len(vals)::BIGINT AS n_values, vals[1]::DOUBLE AS value, CASE WHEN len(vals) > 0 THEN 'complete' ELSE 'unresolved' END AS status FROM v"""


def similarity_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), "role", F.col("text").alias("item"), F.lit("").alias("sample"))
    old, new = turns.filter("role = 'user'").drop("role"), turns.filter("role = 'assistant'").drop("role")
    return compare.best_matches(old, new, "conv_id", 0.2)


def budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(_text()).cast("long").alias("size"))
    return segments.packed(turns, "conv_id", "turn", "size", 1200)


SQL["budget_packing"] = """WITH RECURSIVE o AS (SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
p AS (SELECT conv_id, turn, n, size, size AS used, 0::BIGINT AS batch FROM o WHERE n = 1 UNION ALL
SELECT o.conv_id, o.turn, o.n, o.size, CASE WHEN used > 0 AND used + o.size > 1200 THEN o.size ELSE used + o.size END, CASE WHEN used > 0 AND used + o.size > 1200 THEN batch + 1 ELSE batch END FROM p JOIN o ON o.conv_id = p.conv_id AND o.n = p.n + 1)
SELECT conv_id, turn, size, batch FROM p"""


def html_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.cells(table(spark, sf_dir, "pages"), ["page_id"], "html")


def page_hosts_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", N.host_allowed("url", ["example.com", "example.org"]).alias("allowed"), F.length(N.visible_text("url")).cast("long").alias("chars"))


SQL["page_hosts_allowed"] = r"SELECT page_id, coalesce(regexp_extract(url, '://([^/?#:]+)', 1) IN ('example.com', 'example.org') OR suffix(regexp_extract(url, '://([^/?#:]+)', 1), '.example.com') OR suffix(regexp_extract(url, '://([^/?#:]+)', 1), '.example.org'), false) AS allowed, length(url)::BIGINT AS chars FROM pages"


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return listing.with_any(docs, table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


SQL["labelled_documents"] = "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (doc_category_distribution, doc_latest_by_hash, duplicate_redirect, longest_name_match, score_band_topk, redact_text, residual_scan, id_consistency, fingerprint_incremental, page_lines_first_marker, list_item_records, segment_by_flag, page_coverage, permission_sets, regression_run, license_measurements, similarity_best_match, budget_packing, html_grid, page_hosts_allowed, labelled_documents)
}

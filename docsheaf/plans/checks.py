"""Queries of pages, tables, boxes, versions, guards and sample plans over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.functions import normalize as N
from docsheaf.functions import reports as R
from docsheaf.functions import scopes
from docsheaf.operators import evidence, governance, listing, matching, observations, packs, privacy, requirements, rulepack, sampling, segments, summaries, verdicts, versions
from docsheaf.plans.reviews import lines, orders
from docsheaf.plans.tables import dealt, table
from docsheaf.plans.texts import part_key, part_size, part_type, parts, said
from docsheaf.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(c: str | Column) -> Column:
    return F.array_join(F.col(c).cast("array<string>") if isinstance(c, str) else c.cast("array<string>"), ",")


@registered("""SELECT p_partkey, n AS page_no, CASE WHEN n = 2 THEN 'text layer' ELSE 'ocr' END AS layer, CASE n WHEN 1 THEN p_type || chr(10) ELSE 'page ' || p_size END AS text, n = 2 AND p_partkey % 5 <> 0 AS marked FROM part CROSS JOIN (VALUES (1), (2)) AS v(n) WHERE p_partkey % 5 <> 0 UNION ALL
SELECT p_partkey, NULL, NULL, 'repeated', false FROM part WHERE p_partkey % 5 = 0""")
def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.when(part_key() % 5 == 0, said("--- Page 1 (ocr) ---\nx")).otherwise("")
    docs = parts(spark, sf_dir).select("p_partkey", said("--- Page 1 (ocr) ---\n", part_type(), "\n--- Page 2 (text layer) ---\npage ", part_size(), again).alias("text"))
    rows, twice = segments.pages(docs, "p_partkey", "text")
    shown, _ = files.marked_pages(rows, ["p_partkey"], "page_no", "text", "page", "^$")
    rows = rows.join(shown.select("p_partkey", "page_no", F.lit(True).alias("marked")), ["p_partkey", "page_no"], "left").fillna(False, ["marked"])
    bad = twice.select("p_partkey", F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("layer"), F.lit("repeated").alias("text"), F.lit(False).alias("marked"))
    return rows.select(*bad.columns).unionByName(bad)


@registered("""SELECT l_orderkey, page AS page_no, string_agg(l_partkey::VARCHAR, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM (SELECT *, floor((l_linenumber - 1) / 3)::INT + 1 AS page FROM lineitem) GROUP BY 1, 2""")
def block_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.struct(F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("page_idx"), F.lit("text").alias("type"), F.col("l_partkey").cast("string").alias("text"))
    docs = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", block.alias("b")))), lambda x: x["b"])).alias("blocks"))
    return files.block_pages(docs, "l_orderkey", "blocks")


def _grid_html() -> Column:
    """Two header cells over three columns, an item of two rows, and a row of its own."""
    return said("<p>x</p><table><tr><th>项目</th><th>要求</th><th>结果</th></tr><tr><td rowspan=2>", part_type(), "</td><td>≥1</td><td>", part_size(), "</td></tr><tr><td colspan='2'>&lt;", part_size(), "&gt;</td></tr></table>")


@registered("""WITH g AS (SELECT p_partkey, unnest([{'r': 0, 'c': 0, 't': '项目'}, {'r': 0, 'c': 1, 't': '要求'}, {'r': 0, 'c': 2, 't': '结果'}, {'r': 1, 'c': 0, 't': p_type}, {'r': 1, 'c': 1, 't': '≥1'}, {'r': 1, 'c': 2, 't': p_size::VARCHAR}, {'r': 2, 'c': 0, 't': p_type}, {'r': 2, 'c': 1, 't': '<' || p_size || '>'}, {'r': 2, 'c': 2, 't': '<' || p_size || '>'}]) AS x FROM part)
SELECT p_partkey, 't0r' || x.r || 'c' || x.c AS cell_id, x.t AS text, x.r = 0 AS header FROM g""")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = files.cells(parts(spark, sf_dir).select("p_partkey", _grid_html().alias("html")), ["p_partkey"], "html")
    head = files.header_rows(grid, ["p_partkey"], {"item": ["项目", "检测项目"], "required": ["要求"], "result": ["结果"]})
    return grid.join(head.withColumnRenamed("header_row", "row_no").withColumn("header", F.lit(True)).hint("merge"), ["p_partkey", "table_no", "row_no"], "left").select("p_partkey", "cell_id", "text", F.coalesce("header", F.lit(False)).alias("header"))


@registered("""SELECT p_partkey, r AS row_no, CASE r WHEN 0 THEN p_type ELSE p_type END AS owner, CASE r WHEN 0 THEN p_type || ' | ' || p_size ELSE 'cond ' || p_size END AS line FROM part CROSS JOIN (VALUES (0), (1)) AS v(r)""")
def condition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = said("<table><tr><td>", part_type(), "</td><td>", part_size(), "</td></tr><tr><td> </td><td>cond ", part_size(), "</td></tr></table>")
    grid = files.cells(parts(spark, sf_dir).select("p_partkey", html.alias("html")), ["p_partkey"], "html")
    return files.table_lines(grid, ["p_partkey"]).select("p_partkey", "row_no", "owner", "line")


@registered("""SELECT level, folder, count(*) AS files FROM (SELECT 0 AS level, '' AS folder FROM part UNION ALL SELECT 1, 'root' FROM part UNION ALL SELECT 2, 'root/' || p_brand FROM part UNION ALL SELECT 3, 'root/' || p_brand || '/' || p_type FROM part) GROUP BY 1, 2""")
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.tree(parts(spark, sf_dir).select(F.concat_ws("/", F.lit("file:///root"), "p_brand", "p_type", "p_partkey").alias("path")), "path")


@registered("""WITH c AS (SELECT l_orderkey, string_agg('| ' || concat_ws(' | ', l_partkey, CASE WHEN l_tax > 0.04 THEN 'a\\|b' ELSE '' END, '', l_returnflag) || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS t,
string_agg('- ' || l_partkey || ': ' || l_suppkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1)
SELECT l_orderkey, concat_ws(chr(10) || chr(10), '| item | reported | required | verdict |' || chr(10) || '|---|---|---|---|' || chr(10) || t, f) AS text FROM c""")
def audit_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    checks = rows.select("l_orderkey", "pos", F.col("l_partkey").alias("item"), F.when(F.col("l_tax") > 0.04, "a|b").alias("reported"), F.lit("").alias("required"), F.col("l_returnflag").alias("verdict"))
    findings = rows.filter("l_returnflag = 'R'").select("l_orderkey", "pos", F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("should_be"))
    return sinks.markdown(checks, "l_orderkey", "pos", findings)


@registered("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '无' WHEN o_orderkey % 3 = 0 THEN 'a；b' WHEN o_orderstatus = 'P' THEN 'error ' || o_custkey WHEN o_orderkey % 2 = 0 THEN 'remark' ELSE '' END AS reason FROM orders""")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    findings = F.when(key % 3 == 0, F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    reason = sinks.failure_reason(F.when(status == "F", "pass"), findings, F.when(key % 2 == 0, "remark").otherwise(" "), F.when(status == "P", "failed"), said("error ", F.col("o_custkey")), F.lit(""))
    return orders(spark, sf_dir).select("o_orderkey", reason.alias("reason"))


@registered("""SELECT c_custkey, n_name AS nation, r_name AS region, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS dependants FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def blocked_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    rows = listing.enriched(customer, (table(spark, sf_dir, "nation"), "n_nationkey", "c_nationkey", ["n_name", "n_regionkey"]))
    rows = listing.enriched(rows, (table(spark, sf_dir, "region"), "r_regionkey", "c_nationkey_n_regionkey", ["r_name"]))
    held = listing.blocked_deletes(rows, (orders(spark, sf_dir), "o_custkey"), (orders(spark, sf_dir).filter("o_custkey is null"), "o_orderkey"))
    return held.select(F.col("id").alias("c_custkey"), F.col("c_nationkey_n_name").alias("nation"), F.col("c_nationkey_n_regionkey_r_name").alias("region"), "dependants")


@registered("""SELECT o_orderkey AS id, o_orderdate FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 1000 DAY ORDER BY o_orderdate, o_orderkey LIMIT 200""")
def retention_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest reports past retention, one batch of 200."""
    rows = orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "o_orderdate")
    last = rows.agg(F.max("o_orderdate")).first()[0]
    return listing.retained(rows, "o_orderdate", 1000, F.lit(last))


@registered("""SELECT p_partkey, p_partkey % 4 <> 3 AS readable, CASE WHEN p_partkey % 4 < 3 THEN (p_size BETWEEN 1 AND 20 AND p_partkey % 4 <> 2) OR (p_partkey % 4 = 1 AND p_size BETWEEN 30 AND 40) OR (p_partkey % 4 = 2 AND p_size <= 20 AND p_size % 2 = 0) END AS inside FROM part""")
def scope_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of four spellings, and whether they hold the part's size with two cores, flat for even sizes."""
    text = F.when(part_key() % 4 == 0, "1-20mm²(2-3芯)").when(part_key() % 4 == 1, "1-20(2芯、4芯), 30-40").when(part_key() % 4 == 2, "1-20(2芯,扁形)").otherwise("1-20 2×0.5+1×0.3")
    rows = scopes.with_segments(parts(spark, sf_dir).select("p_partkey", "p_size", text.alias("scope")), "scope")
    shape = F.when(part_size() % 2 == 0, "flat").otherwise("round")
    holds = F.exists("segments", lambda s: sampling.contains(part_size().cast("double"), F.lit(2), shape, s))
    return rows.select("p_partkey", F.col("segments").isNotNull().alias("readable"), holds.alias("inside"))


@registered("""WITH h AS (SELECT DISTINCT o_orderkey, p_name FROM orders JOIN part ON p_partkey BETWEEN o_custkey AND o_custkey + 2), t AS (SELECT o_orderkey, max(length(p_name)) AS m FROM h GROUP BY 1)
SELECT o_orderkey, min(p_name) AS p_name FROM h JOIN t USING (o_orderkey) WHERE length(p_name) = m GROUP BY 1 HAVING count(DISTINCT p_name) = 1""")
def longest_unique_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = orders(spark, sf_dir).select("o_orderkey", F.explode(F.sequence("o_custkey", F.col("o_custkey") + 2)).alias("p_partkey"))
    return matching.longest_unique(near.join(parts(spark, sf_dir), "p_partkey").select("o_orderkey", "p_name"), ["o_orderkey"], "p_name")


@registered("""WITH c AS (SELECT p_type, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1), e AS (SELECT p_brand, p_size, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p.p_partkey, CASE WHEN e.k IS NOT NULL THEN 'valid' WHEN p.p_partkey % 3 = 0 THEN 'corrected' ELSE 'blocked' END AS citation, CASE WHEN e.k IS NULL AND p.p_partkey % 3 = 0 THEN p.p_partkey WHEN e.k IS NOT NULL THEN -1 END AS entry
FROM part AS p LEFT JOIN e ON e.p_brand = p.p_brand AND e.p_size = p.p_size + p.p_partkey % 2""")
def checked_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts cite brand and size, every other one a size too large; every third has a concept that one entry has."""
    catalogue = parts(spark, sf_dir).select("p_brand", "p_size", said("c", part_key()).alias("concept"), part_key().alias("entry"))
    rows = parts(spark, sf_dir).select("p_partkey", "p_brand", (part_size() + part_key() % 2).cast("int").alias("p_size"), F.when(part_key() % 3 == 0, said("c", part_key())).otherwise("?").alias("concept"))
    out = matching.cited(rows, catalogue, ["p_brand", "p_size"], "concept", "entry")
    return out.select("p_partkey", "citation", F.when(F.col("citation") == "valid", -1).otherwise(F.col("entry")).alias("entry"))


@registered("""WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS k FROM lineitem WHERE l_linenumber < 6 GROUP BY 1, 2),
j AS (SELECT l_orderkey, l_linenumber, a.l_orderkey IS NULL OR b.k IS NULL OR (l_orderkey % 7 = 0 AND l_linenumber = 1) AS bad, b.k FROM a FULL JOIN b USING (l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber AS page, concat_ws(chr(10), 'p' || l_linenumber, k) AS text, bool_or(bad) OVER (PARTITION BY l_orderkey) AS conflict FROM j""")
def page_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = dealt(lines(spark, sf_dir), "l_orderkey", "l_linenumber", rows=250_000).groupBy("l_orderkey", F.col("l_linenumber").alias("page")).agg(F.min("l_partkey").alias("k"))
    first = pages.select("l_orderkey", "page", said("p", F.col("page")).alias("text"), F.lit("id").alias("identifier"))
    more = pages.filter("page < 6").select("l_orderkey", "page", F.col("k").cast("string").alias("text"), F.when((F.col("l_orderkey") % 7 == 0) & (F.col("page") == 1), "other").otherwise("id").alias("identifier"))
    return matching.supplemented(first, more, "l_orderkey", "page", "identifier")


@registered("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type END AS found, CASE WHEN p_size % 4 <> 3 THEN ['a', 'b', 'c'][p_size % 4 + 1] END AS column_name, p_partkey % 5 = 0 AS unique_match, p_partkey % 2 = 0 AS corroborated FROM part""")
def box_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes near a gap, cells in column bands, overlapping readings and a second layer, page by page of parts."""
    one = lambda **cols: parts(spark, sf_dir).select("p_partkey", *[v.alias(k) for k, v in cols.items()])
    some = lambda *rows: one(b=F.explode(F.array(*[F.struct(*[v.alias(k) for k, v in r.items()]) for r in rows]))).select("p_partkey", "b.*")
    d = lambda v: F.lit(float(v))
    gaps = one(id=part_key(), left=d(10), top=d(10))
    boxes = some({"left": d(12), "top": F.when(part_key() % 3 == 1, d(14)).otherwise(d(9)), "text": part_type()}, {"left": F.when(part_key() % 3 == 2, d(11)).otherwise(d(99)), "top": d(10), "text": part_type()})
    found = matching.band_matches(gaps, boxes, ["p_partkey"], ["left", "top"], 3).select("p_partkey", "found")
    bands = some(*[{"column": F.lit(c), "lo": d(10 * n), "hi": d(10 * n + 10)} for n, c in enumerate("abc")])
    start = (part_size() % 4 * 10).cast("double")
    cells = one(cell_id=part_key(), left=start + 1, right=start + F.when(part_size() % 4 == 3, 2).otherwise(9))
    placed = evidence.in_columns(cells, bands, ["p_partkey"]).select("p_partkey", F.col("column").alias("column_name"))
    box = {"left": d(0), "right": d(10), "top": d(0), "bottom": d(10)}
    others = one(**(box | {"left": F.when(part_key() % 5 == 0, d(1)).otherwise(d(8))}), text=part_type(), confidence=d(0.9))
    read = evidence.overlapping(one(box_id=part_key(), **box), others, ["p_partkey"]).select("p_partkey", "unique_match")
    layer = lambda flip: one(values=F.array(part_size().cast("double"), F.when(part_key() % 2 == 0, d(2)).otherwise(d(flip))), verdict=F.lit("P"))
    same = evidence.corroborated(layer(1), layer(3), ["p_partkey"]).select("p_partkey", "corroborated")
    return found.join(placed, "p_partkey").join(read, "p_partkey").join(same, "p_partkey")


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'w' || p_size ELSE p_type END AS value, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS prior, p_size % 4 = 0 AS accepted FROM part""")
def second_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A witness that differs for every third part; two attempts that disagree, are unsure, or of one scale."""
    rows = parts(spark, sf_dir).select("p_partkey", part_type().alias("value"))
    witness = parts(spark, sf_dir).select("p_partkey", F.when(part_key() % 3 == 0, said("w", part_size())).otherwise(part_type()).alias("value")).filter("p_partkey % 3 <> 2")
    seen = matching.witnessed(rows, witness, ["p_partkey"], "value")
    tries = parts(spark, sf_dir).select("p_partkey", "p_size", part_type().alias("primary_text"), F.explode(F.array(F.lit(3), F.lit(4))).alias("n"))
    tries = tries.select("p_partkey", "primary_text", F.when((part_size() % 4 == 1) & (F.col("n") == 4), "other").otherwise(F.col("primary_text")).alias("reading"), F.when(part_size() % 4 == 2, 0.9).otherwise(0.99).alias("confidence"), F.when(part_size() % 4 == 3, 3).otherwise(F.col("n")).alias("scale"))
    agreed = matching.agreed_readings(tries, ["p_partkey"], "primary_text", "reading", "confidence", "scale")
    return seen.join(agreed.select("p_partkey", "accepted"), "p_partkey").select("p_partkey", "value", "prior", "accepted")


@registered("""SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(DISTINCT p_brand) FROM part) AS brands, (SELECT count(*) FROM orders) AS calls, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS allowed, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS blocked,
(SELECT array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') FROM orders WHERE o_orderstatus <> 'F') AS types""")
def guard_and_catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = parts(spark, sf_dir).agg(F.count("*").alias("parts"), F.count_distinct("p_brand").alias("brands"))
    ok = F.col("o_orderstatus") == "F"
    records = orders(spark, sf_dir).select(ok.alias("allowed"), F.when(ok, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority")).alias("types"))
    return summaries.side_by_side(counts, summaries.guard_summary(records).withColumn("types", joined("types")))


@registered("""SELECT l_orderkey, (SELECT min_by(l_partkey::VARCHAR, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey) FROM lineitem AS i WHERE i.l_orderkey = l.l_orderkey AND i.l_returnflag = 'R') AS report_no, min_by(l_suppkey::VARCHAR, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey) AS company FROM lineitem AS l GROUP BY 1""")
def first_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("l_orderkey", (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("pos"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string")).otherwise("  ").alias("report_no"), F.col("l_suppkey").cast("string").alias("company"))
    return summaries.first_per_part(rows, "l_orderkey", "pos", ["report_no", "company"])


@registered("""SELECT p_partkey, p_partkey % 3 = 0 AS consistent, CASE WHEN p_partkey % 3 = 0 THEN 'pass' ELSE 'warning' END AS result FROM part""")
def number_hierarchies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number with its parts, numbers of two stems, and one with too long a part; only the first dissolves the warning."""
    base = said("ABCD", part_key() + 100_000, "S")
    stem = F.regexp_replace(base, "S$", "")
    values = F.when(part_key() % 3 == 0, F.array(base, said(stem, "1S"), said(stem, "12S"))).when(part_key() % 3 == 1, F.array(base, said("X", base))).otherwise(F.array(base, said(stem, "1234S")))
    ok = verdicts.hierarchy_consistent(values)
    return parts(spark, sf_dir).select("p_partkey", ok.alias("consistent"), F.when(ok, "pass").otherwise("warning").alias("result"))


@registered("""WITH e AS (SELECT o_custkey, max(o_orderkey % 50) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, (coalesce(m, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::BIGINT AS version_no, CASE WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'active' WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'draft' END AS status,
printf('S%03d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS position FROM orders LEFT JOIN e USING (o_custkey)""")
def version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = orders(spark, sf_dir).withColumn("version_no", F.col("o_orderkey") % 50)
    numbered = versions.next_numbers(every.drop("version_no"), every.filter("o_orderstatus = 'F'"), "o_custkey", "version_no", ["o_orderdate", "o_orderkey"])
    last = every.groupBy("o_custkey").agg(F.max("o_orderkey").alias("top"))
    marked = numbered.join(last, "o_custkey").withColumn("status", F.when(F.col("o_orderstatus") == "F", "active").otherwise("draft"))
    return sampling.labelled(versions.activated(marked, F.col("o_orderkey") == F.col("top")), "o_custkey", "o_orderkey").select("o_orderkey", "version_no", "status", "position")


@registered("""SELECT p_partkey, n::BIGINT AS line, CASE n WHEN 0 THEN 'a b' || chr(9) || p_type ELSE 'z' || p_size END AS text FROM part CROSS JOIN (VALUES (0), (1)) AS v(n)""")
def page_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words: three within a line's height, of which the last stands apart, and one below."""
    word = lambda text, top, left, right: F.struct(text.alias("text"), F.lit(float(top)).alias("top"), F.lit(float(left)).alias("left"), F.lit(float(right)).alias("right"))
    words = F.array(word(F.lit("b"), 2, 12, 20), word(F.lit("a"), 0, 0, 10), word(part_type(), 3, 40, 50), word(said("z", part_size()), 3.5, 0, 9))
    page = parts(spark, sf_dir).select("p_partkey", F.explode(words).alias("w")).select("p_partkey", "w.*")
    return segments.text_lines(page, ["p_partkey"])


@registered("""SELECT p_partkey, 0::BIGINT AS first_row, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS last_row, 2::BIGINT AS n_columns FROM part""")
def column_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rows of two cells; in every other page the last is shifted by more than a fifth of the gap."""
    row = lambda n, shift: F.struct(F.lit(n).alias("row"), F.array(F.lit(10.0), F.lit(60.0) + shift).alias("xs"))
    shift = F.when(part_key() % 2 == 0, 5.0).otherwise(15.0)
    cells = parts(spark, sf_dir).select("p_partkey", F.explode(F.array(*[row(n, F.lit(0.0) if n < 3 else shift) for n in range(4)])).alias("r")).select("p_partkey", "r.*")
    return evidence.column_clusters(cells, ["p_partkey"]).select("p_partkey", "first_row", "last_row", F.col("columns").alias("n_columns"))


@registered("""SELECT o_orderkey, concat_ws(',', CASE WHEN NOT n1 THEN '1' END, CASE WHEN NOT n3 THEN '3' END) AS lacking, n1 AND n3 AS stands
FROM (SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AS n1, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) AS n3 FROM orders)""")
def required_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = orders(spark, sf_dir).select(F.col("o_orderkey").alias("claim_id"), "o_orderkey", F.array(F.lit("1"), F.lit("3")).alias("needs"))
    there = lines(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("string").alias("input"))
    return verdicts.input_guard(claims, there, "o_orderkey", "needs").select("o_orderkey", F.coalesce(joined("lacking"), F.lit("")).alias("lacking"), "stands")


@registered("""SELECT p_partkey, round(p_size * 0.9 - 0.1 + 1e-9, 2) AS least, (p_size BETWEEN 10 AND 20) OR (p_size BETWEEN 30 AND 35) AS permitted, p_size % 3 <> 0 OR p_partkey % 2 = 0 AS stays FROM part""")
def formula_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = part_size().cast("double")
    between = lambda lo, hi: F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    findings = parts(spark, sf_dir).select("p_partkey", F.lit(True).alias("absence_only"), (part_key() % 2 == 0).alias("failed"))
    states = parts(spark, sf_dir).select("p_partkey", F.when(part_size() % 3 == 0, False).when(part_size() % 3 == 1, True).alias("state"))
    left = verdicts.withdrawn_absences(findings, states, ["p_partkey"]).select("p_partkey", F.lit(True).alias("stays"))
    rows = parts(spark, sf_dir).select("p_partkey", verdicts.minimum_thickness(size, 0.9).alias("least"), verdicts.inside_any(size, F.array(between(10, 20), between(30, 35))).alias("permitted"))
    return rows.join(left, "p_partkey", "left").fillna(False, ["stays"])


@registered("""SELECT p_partkey, 'a' || p_partkey || '@x.org,b@y.net' AS found, 'x [email] y [email]' AS clean, CASE WHEN p_size % 2 = 0 THEN 'PVC/C（软）' ELSE '' END AS clauses, CASE p_partkey % 4 WHEN 0 THEN 'plastic' WHEN 1 THEN 'none' END AS filler,
CASE p_partkey % 4 WHEN 2 THEN 'conflict:filler_material' WHEN 3 THEN 'unknown:ambiguous_filler' ELSE 'sample.material_evidence' END AS source, 'No: AB-' || p_partkey || '-77' || CASE WHEN p_size % 3 = 0 THEN ' again AB-' || p_partkey || '-77' ELSE chr(10) || '报告编号 AB-' || p_partkey || '-77' END AS joined FROM part""")
def text_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = said("x a", part_key(), "@x.org y b@y.net")
    material = F.when(part_key() % 4 == 0, "塑料填充").when(part_key() % 4 == 1, "无填充").when(part_key() % 4 == 2, "塑料填充；纤维填芯").otherwise("塑料或纤维填充")
    fact = evidence.filler_fact(material)
    number = said("AB-", part_key(), "-77")
    wrapped = F.when(part_size() % 3 == 0, said("No: ", number, " again ", number)).otherwise(said("No: AB-", part_key(), "-\n77\n报告编号 ", number))
    anchor = r"(?:报告编号|again) ([A-Z0-9-]+)"
    df = parts(spark, sf_dir).select("p_partkey", joined(privacy.detected(text)).alias("found"), privacy.redacted(text).alias("clean"), F.when(part_size() % 2 == 0, "绝缘材料（PVC/C（软））").otherwise("绝缘（护套x）").alias("t"), fact["value"].alias("filler"), fact["source"].alias("source"), evidence.unwrapped(wrapped, "No", anchor).alias("joined"))
    return evidence.with_clauses(df, "t", "绝缘").drop("t").withColumn("clauses", joined("clauses"))


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR END AS value, CASE WHEN p_partkey % 3 = 0 THEN '12.5' END AS bound, CASE p_partkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete' ELSE 'ambiguous' END AS status FROM part""")
def consecutive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = ["抗张强度", "N/mm2", "≥", "12.5"]
    one = F.array(*map(F.lit, record), part_size().cast("string"), F.lit("P"))
    rows = F.when(part_key() % 3 == 0, one).when(part_key() % 3 == 1, F.array(*map(F.lit, [*record, "n/a", "P"]))).otherwise(F.concat(one, one))
    page = parts(spark, sf_dir).select("p_partkey", F.posexplode(rows).alias("pos", "line"))
    labels = spark.createDataFrame([("抗张强度", "N/mm2", "≥")], "label string, unit string, marker string")
    return evidence.vertical_records(page, ["p_partkey"], "pos", labels).select("p_partkey", "value", F.col("limit").alias("bound"), "status").distinct()


@registered("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'name_differs' WHEN o_orderkey % 4 = 2 THEN 'no_status' WHEN o_orderkey % 4 = 3 THEN 'host_not_allowed' END AS reason, CASE WHEN o_orderkey % 2 = 0 THEN 'b=' || o_custkey || '; c=x' ELSE 'c=x' END AS rule_text FROM orders""")
def verification_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    tasks = orders(spark, sf_dir).select(key.alias("task_id"), said("甲(", F.col("o_custkey"), ")公司").alias("expected_name"))
    url = F.when(key % 4 == 3, "https://other.net/x").otherwise("https://a.example.org/y")
    answers = orders(spark, sf_dir).select(key.alias("task_id"), F.when(key % 4 == 1, "乙公司").otherwise(said("甲（", F.col("o_custkey"), "） 公司")).alias("name"), F.when(key % 4 == 2, " ").otherwise("存续").alias("raw_status"), N.host_allowed(url, ["example.org"]).alias("host_ok"), F.create_map(F.lit("c"), F.lit(" x "), F.lit("b"), F.when(key % 2 == 0, F.col("o_custkey").cast("string")).otherwise(" ")).alias("fields"))
    return governance.verification_reasons(answers, tasks, N.company_key).select(F.col("task_id").alias("o_orderkey"), "reason", governance.rule_text(F.col("fields")).alias("rule_text"))


@registered("""SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'rejected' ELSE 'in version 7' END AS outcome FROM part UNION ALL SELECT p_partkey + 1000000000, 'rejected' FROM part WHERE p_size = 1""")
def rule_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = parts(spark, sf_dir).select(part_key().alias("id"), F.when(part_size() % 5 == 0, "retired").otherwise("enabled").alias("status"))
    unknown = parts(spark, sf_dir).filter("p_size = 1").select((part_key() + 1_000_000_000).alias("id"))
    taken, refused = governance.snapshot(rules, rules.select("id").unionByName(unknown), 7)
    return taken.select("id", said("in version ", F.col("version_no")).alias("outcome")).unionByName(refused.select("id", F.lit("rejected").alias("outcome")))


@registered("""SELECT string_agg(p_type || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'PVC' ELSE 'any' END, chr(10) ORDER BY p_partkey) AS context FROM part WHERE p_partkey % 3 <> 1""")
def family_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = parts(spark, sf_dir).select(part_key().alias("id"), part_type().alias("title"), F.when(part_key() % 3 == 0, "PVC").when(part_key() % 3 == 1, "rubber").otherwise("any").alias("rule_text"))
    return governance.active_context(rules, "pvc", {"pvc": "PVC", "rubber": "rubber"})


@registered("""SELECT l_orderkey, string_agg('第' || l_linenumber || '项: ' || l_partkey, '；' ORDER BY l_linenumber, l_partkey, l_suppkey) AS summary FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def actionable_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = lines(spark, sf_dir).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), said("第", F.col("l_linenumber"), "项").alias("item"), F.col("l_partkey").cast("string").alias("note"), F.when(F.col("l_returnflag") == "N", "pass").otherwise("warning").alias("result"))
    return privacy.actionable_summary(checks, ["l_orderkey"], "pos")


@registered("""WITH p AS (SELECT l_orderkey, l_linenumber AS page, min(l_returnflag) AS f, min(l_partkey % 3) AS k FROM lineitem GROUP BY 1, 2), c AS (SELECT *, f = 'R' AS cover, count(*) FILTER (f = 'R') OVER w AS covers FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY page ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, lag(k) OVER (PARTITION BY l_orderkey ORDER BY page) AS last_key, covers > 0 AND row_number() OVER (PARTITION BY l_orderkey, covers ORDER BY page) = 1 AS pending FROM c)
SELECT l_orderkey, page, sum(CASE WHEN cover OR (k IS DISTINCT FROM last_key AND NOT (pending AND NOT cover)) THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY page ROWS UNBOUNDED PRECEDING)::BIGINT AS specimen FROM d""")
def specimen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).groupBy("l_orderkey", F.col("l_linenumber").alias("page")).agg(F.min("l_returnflag").alias("f"), F.min(F.col("l_partkey") % 3).alias("k"))
    return segments.specimens(rows, "l_orderkey", "page", F.col("f") == "R", F.col("k")).select("l_orderkey", "page", F.col("specimen").cast("long").alias("specimen"))


@registered("""SELECT p_brand, unnest(range(1, t - f + 1)) AS item_no FROM (SELECT p_brand, least(max(p_size), 999) AS t, min(p_size) AS f FROM part GROUP BY 1) WHERE t > f""")
def demand_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = parts(spark, sf_dir).groupBy("p_brand").agg(F.max("p_size").alias("total"), F.min("p_size").alias("filed"))
    return sampling.demands(groups, ["p_brand"])[0].select("p_brand", F.col("item_no").cast("long").alias("item_no"))


@registered("""SELECT p_brand, id FROM (SELECT p_brand, bool_or(p_type = 'PROMO') AS promo, bool_and(p_size > 1) AS large, count(*) AS n FROM part GROUP BY 1) JOIN (VALUES ('promo'), ('large'), ('many')) AS v(id) ON (id = 'promo' AND promo) OR (id = 'large' AND large) OR (id = 'many' AND n >= 90)""")
def applicable_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = parts(spark, sf_dir).select("p_brand", part_type().alias("series"), F.when(part_size() > 1, "70C").otherwise("90C").alias("temperature"), part_key().alias("model"))
    rows = [("promo", ["PROMO"], None, None), ("large", None, "70C", None), ("many", None, None, 90)]
    needs = spark.createDataFrame(rows, "id string, any_series array<string>, all_temperature string, min_models int")
    return sampling.applicable(needs, models, "p_brand").select("p_brand", "id")


@registered("""WITH s AS (SELECT p_brand, p_partkey, p_size, p_type FROM part), gone AS (SELECT p_brand, 'illegal_sample' AS gap, p_partkey::VARCHAR AS what FROM s WHERE p_size % 10 = 0),
seen AS (SELECT DISTINCT p_brand, p_type FROM s WHERE p_size % 10 <> 0 AND p_size % 2 = 1), t AS (SELECT DISTINCT p_brand, p_type FROM s)
SELECT * FROM gone UNION ALL SELECT p_brand, 'uncovered_task', p_type FROM t ANTI JOIN seen USING (p_brand, p_type) UNION ALL SELECT DISTINCT p_brand, 'color_pair', 'white and black' FROM s GROUP BY 1 HAVING count(DISTINCT CASE WHEN p_size = 49 THEN 'white' WHEN p_size = 48 THEN 'black' END) < 2""")
def plan_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as samples: those of every tenth size are no candidates, only odd sizes cover their type."""
    p = parts(spark, sf_dir)
    cands = p.filter("p_size % 10 <> 0").select("p_brand", part_key().alias("candidate"))
    tasks = p.select("p_brand", part_type().alias("task"), F.lit("type").alias("kind")).distinct().unionByName(p.select("p_brand", F.lit("colors").alias("task"), F.lit("color_pair").alias("kind")).distinct())
    pairs = p.filter("p_size % 2 = 1").select("p_brand", part_type().alias("task"), part_key().alias("candidate"))
    samples = p.select("p_brand", part_key().alias("position"), part_key().alias("candidate"), F.when(part_size() == 49, "white").when(part_size() == 48, "black").alias("color"), F.lit(False).alias("any_spec"))
    return sampling.plan_gaps(samples, cands, tasks, pairs, "p_brand")


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 6 = 0 THEN false WHEN p_partkey % 2 = 0 THEN p_size % 2 = 0 AND p_partkey % 4 <> 0 ELSE false END AS any_spec, p_partkey % 2 = 0 AND p_partkey % 4 = 0 AS shape_explicit FROM part""")
def edited_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of even parts stood in the version before; every fourth has changed its shape, every sixth has a colour."""
    color = F.when(part_key() % 6 == 0, "white")
    old = parts(spark, sf_dir).filter("p_partkey % 2 = 0").select(part_key().alias("id"), F.lit("flat").alias("shape"), color.alias("color"), (part_size() % 2 == 0).alias("any_spec"))
    new = parts(spark, sf_dir).select(part_key().alias("id"), F.when(part_key() % 4 == 0, "round").otherwise("flat").alias("shape"), color.alias("color"), F.lit(False).alias("any_spec"))
    return sampling.normalized_samples(new, old, ["shape", "color"]).select(F.col("id").alias("p_partkey"), "any_spec", "shape_explicit")


@registered("""SELECT p_partkey, pos::INT AS pos, CASE pos WHEN 0 THEN 'RVVP' WHEN 1 THEN NULL ELSE 'RVV' END AS model, CASE pos WHEN 0 THEN 1 WHEN 1 THEN 0 END::INT AS segments, CASE pos WHEN 0 THEN '' WHEN 1 THEN 'unknown_model' ELSE 'unreadable_scope' END AS issues FROM part CROSS JOIN (VALUES (0), (1), (2)) AS v(pos)""")
def scope_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = spark.createDataFrame([("RVV",), ("RVVP",)], "model string")
    text = said("RVVP 0.5-", part_size(), "(2-4芯)；ABC ", part_size(), "\nrvv x(", part_size(), "芯)")
    rows = sampling.scope_entries(parts(spark, sf_dir).select("p_partkey", text.alias("t")), "p_partkey", "t", models)
    return rows.select("p_partkey", "pos", "model", F.when(F.col("segments").isNotNull(), F.size("segments")).alias("segments"), joined("issues").alias("issues"))


_REVIEWS = [
    ("认证单元划分与型式试验送样规则", "x", "x", "x", "manual_review", "manual_review"),
    ("审核人签字核对", "x", "x", "x", "manual_review", "manual_review"),
    ("成束阻燃性能", "P", "是否适用", "x", "manual_review", "manual_review"),
    ("备注引用报告编号", "1", "确认是否适用", "x", "manual_review", "manual_review"),
    ("低温弯曲", "1 h", "预冷4h", "x", "manual_review", "manual_review"),
    ("低温拉伸", "30 min", "预冷", "x", "manual_review", "manual_review"),
    ("外径", "P", "不要求", "x", "correction", "fail"),
    ("标志", "1", "无需修改", "x", "correction", "fail"),
    ("标志", "1", "应为 2", "规则库尚未解析", "correction", "fail"),
    ("标志", "1", "", "需人工复核", None, "pass"),
    ("标志", "未提供", "", "", None, "pass"),
    ("成品电压", "击穿", "", "", None, "pass"),
    ("绝缘最薄处厚度", "1", "", "", None, "pass"),
    ("失重", "1", "", "", None, "pass"),
    ("热延伸", "1", "", "", None, "pass"),
    ("外径", "1", "", "", None, "pass"),
]


@registered("""SELECT l_orderkey % 16 AS kind, CASE l_orderkey % 16 WHEN 9 THEN 'manual_review' WHEN 10 THEN 'manual_review' WHEN 11 THEN 'manual_review' WHEN 12 THEN CASE WHEN l_linenumber = 7 THEN 'manual_review' WHEN l_discount > 0.05 THEN 'fail' ELSE 'pass' END
WHEN 13 THEN CASE WHEN l_linenumber = 7 THEN 'manual_review' WHEN l_quantity > 2 THEN 'fail' ELSE 'pass' END WHEN 14 THEN CASE WHEN l_linenumber = 7 THEN 'manual_review' ELSE 'pass' END ELSE 'pass' END AS verdict, count(*) AS n FROM lineitem WHERE l_orderkey % 16 >= 9 GROUP BY 1, 2""")
def review_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a check of one of sixteen kinds; nine kinds are withdrawn, six may change their verdict."""
    kind = (F.col("l_orderkey") % 16).cast("int")
    names = ("item", "reported", "should_be", "note", "action_type", "verdict")
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]).cast("string") for r in _REVIEWS]), kind + 1)
    known = F.col("l_linenumber") != 7
    checks = lines(spark, sf_dir).select(kind.cast("long").alias("kind"), *[pick(k).alias(n) for k, n in enumerate(names)], F.when(known, F.when(F.col("l_discount") > 0.05, -0.02).otherwise(0.0)).alias("margin"), F.when(known, F.col("l_quantity")).alias("measured"))
    kept, _ = rulepack.apply_rule_pack(checks, packs.REVIEW_PACK)
    return kept.groupBy("kind", "verdict").agg(F.count("*").alias("n"))


@registered("""WITH t(item, label, unit) AS (VALUES ('average_thickness', '护套平均厚度', 'mm'), ('minimum_thickness', '绝缘最薄处厚度', 'mm'), ('outer_diameter', '平均外径', 'mm'), ('tensile_strength', '抗张强度', 'N/mm2'), ('elongation', '断裂伸长率', '%'), ('loss_of_mass', '失重', 'mg/cm2'), ('indentation', '压痕深度', '%'), ('conductor_resistance', '导体电阻', 'Ω/km'), ('insulation_resistance', '绝缘电阻', 'MΩ·km'), ('hot_set', '热延伸', '%'))
SELECT p_partkey, item, unit, CASE WHEN p_partkey % 3 = 0 THEN 7.5::DOUBLE END AS bound, CASE WHEN p_partkey % 4 <> 0 THEN p_size || '.5,2.0' ELSE '' END AS nums, CASE WHEN p_partkey % 4 = 0 THEN 'unresolved' ELSE 'complete' END AS status FROM part CROSS JOIN t""")
def report_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lines a part, each with a label of its own, perhaps a limit, and two values or none."""
    labels = ("护套平均厚度", "绝缘最薄处厚度", "平均外径", "抗张强度", "断裂伸长率", "失重", "压痕深度", "导体电阻", "绝缘电阻", "热延伸")
    line = parts(spark, sf_dir).select("p_partkey", F.explode(F.array(*map(F.lit, labels))).alias("label"), F.concat(F.when(part_key() % 3 == 0, "≥ 7.5 ").otherwise(""), F.when(part_key() % 4 != 0, said(part_size(), ".5 / 2")).otherwise("无")).alias("rest"))
    found = rulepack.extract_measurements(line.select("p_partkey", F.concat("label", F.lit("："), "rest").alias("line")), ["p_partkey"], "line", packs.MEASUREMENTS)
    return found.select("p_partkey", "item", "unit", F.col("limit").alias("bound"), joined("values").alias("nums"), "status")


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brands as applications, their parts as candidates, and one requirement of most kinds."""
    p = parts(spark, sf_dir)
    cands = p.select("p_brand", part_key().alias("candidate"), part_size().cast("double").alias("section"), (part_key() % 4 + 1).cast("int").alias("cores"), F.when(part_key() % 2 == 0, "round").otherwise("flat").alias("shape"), said("m", part_key() % 3).alias("model_ref"), part_type().alias("series"), F.when(part_size() > 25, "90C").otherwise("70C").alias("temperature"), said("u", part_size() % 2).alias("subunit"), F.when(part_size() % 5 == 0, part_type()).alias("screening_group"), (part_key() % 3 == 0).alias("sheath"))
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    need = lambda rid, kind, models=None, subunit=None, sheathed=None, values=None, section=None, cores=None: F.struct(F.lit(rid).alias("id"), F.lit(kind).alias("kind"), (strings(*models) if models else strings()).alias("models"), F.lit(subunit).cast("string").alias("subunit"), F.lit(sheathed).cast("boolean").alias("sheathed"), (strings(*values) if values else strings()).alias("values"), F.lit(section).cast("string").alias("section"), F.lit(cores).cast("string").alias("cores"), F.lit(True).alias("hard"))
    rows = [
        need("a", "per_model_section_endpoints", ["m1"]), need("b", "corner_pair", subunit="u1"), need("c", "unit_section_endpoints"), need("d", "temperature_presence", values=["70C", "90C"]),
        need("e", "model_set_presence", ["m0", "m2"]), need("f", "exact_model_sample", ["m2"], section="actual_max"), need("g", "shape_pair", values=["round", "flat"]), need("h", "series_sheathed_presence"),
        need("i", "screening_group_presence"), need("j", "unsheathed_representation"), need("k", "temperature_distribution", subunit="u0", values=["90C"]), need("l", "subunit_representation", subunit="u0"), need("m", "series_presence"),
    ]
    needs = p.select("p_brand").distinct().select("p_brand", F.explode(F.array(*rows)).alias("r")).select("p_brand", "r.*")
    return needs, cands


_CANDS = """c AS (SELECT p_brand, p_partkey, p_size::DOUBLE AS section, (p_partkey % 4 + 1)::INT AS cores, CASE WHEN p_partkey % 2 = 0 THEN 'round' ELSE 'flat' END AS shape, 'm' || p_partkey % 3 AS model_ref, p_type AS series, CASE WHEN p_size > 25 THEN '90C' ELSE '70C' END AS temperature, 'u' || p_size % 2 AS subunit, CASE WHEN p_size % 5 = 0 THEN p_type END AS grp, p_partkey % 3 = 0 AS sheath FROM part)"""
_TASKS = """t AS (SELECT p_brand, 'a:min' AS task, min(section) AS section, NULL::INT AS cores FROM c WHERE model_ref = 'm1' GROUP BY 1 UNION ALL SELECT p_brand, 'a:max', max(section), NULL FROM c WHERE model_ref = 'm1' GROUP BY 1
UNION ALL SELECT p_brand, 'b:max-cores-min-section', min(section), max(cores) FROM c JOIN (SELECT p_brand, max(cores) AS x FROM c WHERE subunit = 'u1' GROUP BY 1) USING (p_brand) WHERE subunit = 'u1' AND cores = x GROUP BY 1
UNION ALL SELECT p_brand, 'b:min-cores-max-section', max(section), min(cores) FROM c JOIN (SELECT p_brand, min(cores) AS x FROM c WHERE subunit = 'u1' GROUP BY 1) USING (p_brand) WHERE subunit = 'u1' AND cores = x GROUP BY 1
UNION ALL SELECT p_brand, 'c:min', min(section), NULL FROM c GROUP BY 1 UNION ALL SELECT p_brand, 'c:max', max(section), NULL FROM c GROUP BY 1
UNION ALL SELECT DISTINCT p_brand, k, NULL::DOUBLE, NULL::INT FROM c CROSS JOIN (VALUES ('d:70C'), ('d:90C'), ('g:round'), ('g:flat'), ('j:unsheathed')) AS v(k)
UNION ALL SELECT DISTINCT p_brand, 'e:' || model_ref, NULL::DOUBLE, NULL::INT FROM c WHERE model_ref IN ('m0', 'm2') UNION ALL SELECT p_brand, 'f:m2', max(section), NULL FROM c WHERE model_ref = 'm2' GROUP BY 1
UNION ALL SELECT DISTINCT p_brand, 'h:' || series, NULL::DOUBLE, NULL::INT FROM c WHERE sheath UNION ALL SELECT DISTINCT p_brand, 'i:' || grp, NULL::DOUBLE, NULL::INT FROM c WHERE grp IS NOT NULL
UNION ALL SELECT DISTINCT p_brand, k, NULL::DOUBLE, NULL::INT FROM c CROSS JOIN (VALUES ('k:u0-90C'), ('l:representative')) AS v(k) WHERE subunit = 'u0' UNION ALL SELECT DISTINCT p_brand, 'm:' || series, NULL::DOUBLE, NULL::INT FROM c)"""


@registered(f"WITH {_CANDS}, {_TASKS} SELECT * FROM t")
def requirement_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs, cands = _plan(spark, sf_dir)
    return requirements.tasks(needs, cands, "p_brand").select("p_brand", "task", "section", "cores")


@registered(f"""WITH {_CANDS}, {_TASKS}, q AS (SELECT section, row_number() OVER (ORDER BY section) AS r FROM (SELECT DISTINCT section FROM c)),
x AS (SELECT t.p_brand, t.task, c.p_partkey, t.section AS ts, c.section AS cs, t.cores AS tc, c.cores AS cc, left(t.task, 1) AS k, split_part(t.task, ':', 2) AS v, c.* EXCLUDE (p_brand, p_partkey, section, cores), qt.r AS rt, qc.r AS rc FROM t JOIN c USING (p_brand) LEFT JOIN q AS qt ON qt.section = t.section LEFT JOIN q AS qc ON qc.section = c.section),
m AS (SELECT * FROM x WHERE (ts IS NULL OR cs = ts OR (k NOT IN ('a', 'f') AND cs <= 10 AND ts <= 10 AND abs(rt - rc) = 1)) AND (tc IS NULL OR cc = tc OR abs(cc - tc) = 1)
 AND CASE k WHEN 'a' THEN model_ref = 'm1' WHEN 'd' THEN temperature = v WHEN 'e' THEN model_ref = v WHEN 'f' THEN model_ref = v WHEN 'g' THEN shape = v WHEN 'h' THEN series = v AND sheath WHEN 'i' THEN coalesce(grp = v, false) WHEN 'j' THEN NOT sheath WHEN 'k' THEN subunit = 'u0' AND temperature = '90C' WHEN 'l' THEN subunit = 'u0' WHEN 'm' THEN series = v ELSE true END)
SELECT p_brand, task, count(*) AS candidates, sum(CASE WHEN ts IS NOT NULL AND cs <> ts THEN CASE WHEN k = 'b' THEN 4 ELSE 2 END ELSE 0 END + CASE WHEN tc IS NOT NULL AND cc <> tc THEN CASE WHEN k = 'b' THEN 2 ELSE 1 END ELSE 0 END)::BIGINT AS cost FROM m GROUP BY 1, 2""")
def requirement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs, cands = _plan(spark, sf_dir)
    sequence = sampling.ranked_sequence(cands.select("section", F.lit(1).alias("one")), ["one"], "section").drop("one")
    done = requirements.pairs(requirements.tasks(needs, cands, "p_brand"), cands, "p_brand", sequence)
    return done.groupBy("p_brand", "task").agg(F.count("*").alias("candidates"), F.sum("cost").alias("cost"))


_CONDITIONS = {"model_applied": "string", "all_models": "array<string>", "any_models": "array<string>", "subunit_applied": "string", "subunits_applied": "array<string>", "none_subunits_applied": "array<string>", "unit_applied": "string", "any_standard_family": "string", "any_temperature_class": "string", "any_unsheathed_model": "boolean", "any_sheathed_model": "boolean", "any_screened_model": "boolean", "series_contains_sheathed_model": "boolean", "series_applied": "array<string>", "contains_both": "array<string>"}


@registered("""WITH f AS (SELECT p_brand || '/' || floor(p_size / 10)::INT AS app, list(DISTINCT 'm' || p_partkey % 5) AS refs, list(DISTINCT 'u' || p_size % 3) AS subs, list(DISTINCT p_type) AS ser, bool_or(p_size > 25) AS hot, bool_or(p_partkey % 3 = 0) AS sheathed, bool_or(p_partkey % 3 <> 0) AS bare, bool_or(p_size % 5 = 0) AS screened FROM part GROUP BY 1)
SELECT app, id FROM f JOIN (VALUES ('model'), ('all'), ('any'), ('sub'), ('subs'), ('none'), ('family'), ('temp'), ('bare'), ('sheathed'), ('screened'), ('series'), ('both'), ('free'), ('held')) AS v(id) ON CASE id WHEN 'model' THEN list_contains(refs, 'm1') WHEN 'all' THEN list_contains(refs, 'm1') AND list_contains(refs, 'm2') WHEN 'any' THEN list_contains(refs, 'm3') OR list_contains(refs, 'm9')
 WHEN 'sub' THEN list_contains(subs, 'u1') WHEN 'subs' THEN list_contains(subs, 'u0') AND list_contains(subs, 'u2') WHEN 'none' THEN NOT list_contains(subs, 'u2') WHEN 'family' THEN list_contains(ser, 'PROMO') WHEN 'temp' THEN hot WHEN 'bare' THEN bare WHEN 'sheathed' THEN sheathed WHEN 'screened' THEN screened WHEN 'series' THEN list_contains(ser, 'SMALL') OR list_contains(ser, 'x') WHEN 'both' THEN sheathed AND bare WHEN 'free' THEN true ELSE false END""")
def requirement_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen requirements, each with a condition of its own, over brands by size class as applications."""
    flexible = F.when(part_key() % 3 == 0, "soft").otherwise("stiff")
    models = parts(spark, sf_dir).select(F.concat_ws("/", "p_brand", F.floor(part_size() / 10).cast("string")).alias("app"), F.lit("07").alias("unit"), said("m", part_key() % 5).alias("model_ref"), said("u", part_size() % 3).alias("subunit"), part_type().alias("series"), F.when(part_size() > 25, "90C").otherwise("70C").alias("temperature"), (part_key() % 3 == 0).alias("sheath"), F.when(part_size() % 5 == 0, "g").alias("screening_group"), F.lit("copper").alias("conductor"), flexible.alias("flexibility"), F.lit(None).cast("string").alias("shape"))
    rows = [("model", {"model_applied": "m1"}), ("all", {"all_models": ["m1", "m2"]}), ("any", {"any_models": ["m3", "m9"]}), ("sub", {"subunit_applied": "u1"}), ("subs", {"subunits_applied": ["u0", "u2"]}), ("none", {"none_subunits_applied": ["u2"]}), ("family", {"any_standard_family": "PROMO"}), ("temp", {"any_temperature_class": "90C"}), ("bare", {"any_unsheathed_model": True}), ("sheathed", {"any_sheathed_model": True}), ("screened", {"any_screened_model": True}), ("series", {"series_applied": ["SMALL", "x"]}), ("both", {"contains_both": ["soft", "stiff"]}), ("free", {"unit_applied": "7"}), ("held", {})]
    schema = "id string, unit string, status string, when struct<" + ", ".join(f"{n}: {t}" for n, t in _CONDITIONS.items()) + ">"
    needs = spark.createDataFrame([(i, "07", "retired" if i == "held" else "enabled", tuple(w.get(n) for n in _CONDITIONS)) for i, w in rows], schema)
    return requirements.applicable(needs, models, "app").select("app", "id")


@registered("""WITH s AS (SELECT p_brand, p_partkey, p_size, p_size % 3 = 0 AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_brand, string_agg(n || '. ' || CASE WHEN a THEN '任意规格一件' ELSE '3×' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END || 'mm²' END || ' 圆形' || CASE WHEN p_brand < 'Brand#3' AND n = 1 THEN ' 白色' WHEN p_brand < 'Brand#3' AND n = 2 THEN ' 黑色' ELSE '' END, chr(10) ORDER BY n) AS text FROM s GROUP BY 1""")
def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a brand's samples; some brands need a pair of colours, and sizes that three divides are free."""
    samples = parts(spark, sf_dir).select("p_brand", part_key().alias("candidate"), part_size().alias("size"))
    every = samples.select("p_brand", F.col("candidate").cast("string").alias("task"), "candidate")
    targets = samples.select("p_brand", F.col("candidate").cast("string").alias("task"), F.when(F.col("size") % 3 != 0, F.col("size")).alias("section"), F.lit(None).cast("int").alias("cores"), F.lit(None).cast("string").alias("shape"))
    free = requirements.relaxed(every, targets, "p_brand")
    rows = requirements.with_color_pair(samples.join(free, ["p_brand", "candidate"]), samples.filter("p_brand < 'Brand#3'"), "p_brand", "candidate")
    section = F.col("size") + F.when(F.col("candidate") % 2 == 0, F.lit(0.5)).otherwise(0)
    return requirements.copy_text(rows, "p_brand", "candidate", requirements.spec_text(section, F.lit(3), F.lit("round"), F.col("color"), F.col("any_spec")))


@registered("""SELECT p_partkey, c AS category, 2::BIGINT AS total, CASE WHEN c = '绝缘' THEN 1 ELSE 0 END::BIGINT AS filed, CASE WHEN c = '绝缘' THEN '乙' || p_size || ',甲' ELSE '丁' || p_size || ',丙' END AS brands, c = '护套' AND p_partkey % 2 = 0 AS needs_review FROM part CROSS JOIN (VALUES ('绝缘'), ('护套')) AS v(c)""")
def material_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = said("绝缘：甲√(CQC-", part_key() + 1000, ")、乙", part_size(), "；护套: 丙", F.when(part_key() % 2 == 0, "√").otherwise(""), "，丁", part_size())
    return requirements.material_groups(parts(spark, sf_dir).select("p_partkey", text.alias("t")), "p_partkey", "t").withColumn("brands", joined("brands"))


def _page(*rows: tuple[Column | str, float, float]) -> Column:
    return F.array(*[F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), *[F.lit(float(v)).alias(n) for n, v in (("left", x), ("right", x + 10), ("top", y))]) for t, x, y in rows])


def _boxes(*rows: tuple[Column | str, float, float]) -> Column:
    return F.explode(_page(*rows)).alias("b")


@registered("""SELECT p_partkey, n::BIGINT AS row_no, CASE n WHEN 1 THEN '厚度' ELSE '外径' END AS item, CASE n WHEN 1 THEN p_size || '.5' WHEN 2 THEN CASE WHEN p_partkey % 3 = 1 THEN least('7', p_size::VARCHAR) ELSE p_size::VARCHAR END END AS result, CASE WHEN n = 2 AND p_partkey % 3 = 1 THEN 'several_values' END AS reason FROM part CROSS JOIN (VALUES (1), (2)) AS v(n) WHERE p_partkey % 3 < 2
UNION ALL SELECT p_partkey, NULL, NULL, NULL, 'header_not_unique' FROM part WHERE p_partkey % 3 = 2""")
def coordinate_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of boxes: a header, two rows, in every third a second value, in every third two headers."""
    size = part_size().cast("string")
    base = [("项 目", 0, 0), ("结果", 50, 1), ("厚度", 2, 20), (said(size, ".5"), 48, 22), ("外径", 1, 40), (size, 52, 41)]
    # One read: a union of tables dealt by one key counts as dealt by it, even where it isn't once Spark shares their shuffles.
    page = F.when(part_key() % 3 == 1, _page(*base, ("7", 40, 42))).when(part_key() % 3 == 2, _page(*base, ("结果", 80, 0))).otherwise(_page(*base))
    boxes = parts(spark, sf_dir).select("p_partkey", F.explode(page).alias("b")).select("p_partkey", "b.*")
    rows = observations.coordinate_rows(boxes, ["p_partkey"], {"item": ["项目"], "result": ["结果"]})
    return rows.select("p_partkey", F.col("row").alias("row_no"), "item", "result", "reason")


@registered("""SELECT p_partkey, 'depth' AS item, CASE WHEN p_partkey % 4 = 0 THEN p_size || '.5' END AS value, CASE p_partkey % 4 WHEN 1 THEN 'no_value' WHEN 2 THEN 'several_values' WHEN 3 THEN 'label_not_unique' END AS reason, 'As:' || p_size || ',Sb:2' AS elements FROM part""")
def box_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = said(part_size(), ".5")
    kinds = {0: [("压痕深度", 0, 0), (value, 30, 2), ("9", 30, 50)], 1: [("压痕深度", 0, 0), ("无", 30, 0)], 2: [("压痕深度", 0, 0), (value, 30, 0), ("8", 60, 1)], 3: [("压痕深度", 0, 0), ("压痕深度", 0, 90), (value, 30, 0)]}
    pages = [parts(spark, sf_dir).filter(f"p_partkey % 4 = {k}").select("p_partkey", _boxes(*rows)).select("p_partkey", "b.*") for k, rows in kinds.items()]
    boxes = pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])
    seen = observations.labelled_boxes(boxes, ["p_partkey"], {"depth": "压痕深度"}, r"\d+(?:\.\d+)?")
    html = said("<table><tr><td>元素</td><td>S1</td></tr><tr><td>As</td><td>", part_size(), "</td></tr><tr><td>x</td><td>1</td></tr><tr><td>Sb</td><td>2</td></tr></table>")
    grid = files.cells(parts(spark, sf_dir).select("p_partkey", html.alias("html")), ["p_partkey"], "html")
    rows = observations.element_rows(grid, ["p_partkey"], ["As", "Sb"]).filter("specimen = 'S1' and element <> value")
    return seen.join(rows.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "element", "value"))), ",").alias("elements")), "p_partkey")


@registered("""WITH d AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN n = 1 THEN k END AS looked_up, p_partkey % 3 <> 2 AS same, p_type || ',ab' || p_size AS kept, CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '' END AS wrong FROM part LEFT JOIN d USING (p_brand, p_size)""")
def issue_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension = parts(spark, sf_dir).select("p_brand", "p_size", part_key().alias("looked_up"))
    rows = observations.looked_up(parts(spark, sf_dir), dimension, ["p_brand", "p_size"], ["looked_up"])
    left = F.when(part_key() % 3 == 0, "绝缘失重").when(part_key() % 3 == 1, "标志（内容）").otherwise("绝缘失重")
    right = F.when(part_key() % 3 == 0, "绝缘失重试验").when(part_key() % 3 == 1, "标志").otherwise("护套失重")
    same = observations.same_issue(R.item_concept(left), R.item_concept(right), left, right)
    values = F.array(said(" ", part_type(), "："), F.lit("[企业名称已脱敏]"), F.lit("x"), said("a b", part_size(), "|"), part_type())
    wrong = observations.change_consistent(F.array(F.lit("10.0"), F.lit("10.0")), F.array(F.lit("8.5"), F.lit("8.5")), F.array(F.lit("-15"), F.when(part_key() % 2 == 0, "-20").otherwise("-15")))
    return rows.select("p_partkey", "looked_up", same.alias("same"), joined(observations.unique_values(values)).alias("kept"), joined(wrong).alias("wrong"))


@registered("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, min(l_linenumber) AS p FROM lineitem WHERE l_tax > 0.02 GROUP BY 1, 2, 3, 4), e AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
x AS (SELECT l_orderkey, count(*) AS errors FROM (SELECT o_orderkey AS l_orderkey FROM orders CROSS JOIN (VALUES (1), (2)) AS v(k) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.l_orderkey = o_orderkey AND e.l_linenumber = k) UNION ALL SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(DISTINCT l_linenumber) > 1) GROUP BY 1)
SELECT o_orderkey, (SELECT count(*) FROM l WHERE l.l_orderkey = o_orderkey) AS issues, coalesce(x.errors, 0) AS errors, CASE WHEN o_orderstatus = 'F' THEN (SELECT max(l_shipdate) FROM lineitem AS i WHERE i.l_orderkey = o_orderkey AND l_returnflag = 'R') END AS completed_at FROM orders LEFT JOIN x ON x.l_orderkey = o_orderkey""")
def report_issue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("reported"), F.col("l_returnflag").alias("should_be"), (F.col("l_tax") > 0.02).alias("action_required"))
    issues = observations.all_issues(rows.filter("pos <= 2"), rows.filter("pos > 2"), rows.columns).groupBy("report_id").agg(F.count("*").alias("issues"))
    expected = orders(spark, sf_dir).select(F.col("o_orderkey").alias("report_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("token"))
    taken = lines(spark, sf_dir).select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("token"), F.col("l_suppkey").alias("slot"))
    errors = observations.assignment_errors(expected, taken, ["report_id"], "token", "slot").groupBy("report_id").agg(F.count("*").alias("errors"))
    reports = orders(spark, sf_dir).select(F.col("o_orderkey").alias("report_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    tasks = lines(spark, sf_dir).select(F.col("l_orderkey").alias("report_id"), F.when(F.col("l_returnflag") == "R", "done").otherwise("failed").alias("task_status"), "l_shipdate")
    done = observations.review_completed(reports, tasks, "report_id", "status", "l_shipdate")
    return done.join(issues, "report_id", "left").join(errors, "report_id", "left").fillna(0, ["issues", "errors"]).select(F.col("report_id").alias("o_orderkey"), "issues", "errors", "completed_at")


@registered("""SELECT c_custkey, o_orderkey AS change_id, CASE WHEN o_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) ELSE 1 END AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def rule_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("change_id"), F.col("o_orderdate").alias("changed_at"))
    return observations.change_log(table(spark, sf_dir, "customer").select("c_custkey"), log, "c_custkey").select("c_custkey", "change_id", F.col("n").cast("long").alias("n"))


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'warning' ELSE 'pass' END AS result, CASE WHEN p_partkey % 4 <> 3 THEN CASE WHEN p_partkey % 3 = 0 THEN 'no AB-' || p_size || ', [email], ab ' || p_size || ' AB-' || p_size || '0' || chr(10) || '编号一致性: 识别到多个不同编号，需人工核对' ELSE 'no AB-' || p_size || ', [email], ab ' || p_size END END AS text, p_partkey % 4 = 3 AS blocked FROM part""")
def release_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of a number, for every third part another number; a secret that has no placeholder blocks a text."""
    odd = privacy.Pattern("odd", "~+", "~")
    text = said("no AB-", part_size(), ", a@x.org, ab ", part_size(), F.when(part_key() % 3 == 0, said(" AB-", part_size(), "0")).otherwise(""), F.when(part_key() % 4 == 3, " ~~").otherwise(""))
    rows = privacy.preflight(parts(spark, sf_dir).select("p_partkey", text.alias("text")), "text", {"编号一致性": r"(?i)AB[- ]\d+", "other": "CD-\\d+"}, [*privacy.DEFAULT, odd])
    return rows.select("p_partkey", F.get("logic_checks", F.lit(0))["result"].alias("result"), "text", "blocked")

"""Queries over orders, customers, suppliers and events, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsheaf.functions import normalize as N
from docsheaf.operators import compare, governance, listing, matching, summaries, verdicts, versions
from docsheaf.plans.tables import table
from docsheaf.streaming import intake

SQL: dict[str, str] = {}


def report_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey", "left")
    rows = listing.filtered(orders, {"o_orderstatus": "O"}, {"o_orderpriority": "high"}, datetime(1996, 1, 1), datetime(1999, 1, 1), "o_orderdate", (["c_name", "c_mktsegment"], "mach"))
    return listing.page(rows, "o_orderdate", "o_orderkey", 2, 20).select("o_orderkey", "c_name", "o_orderdate", "o_totalprice")


SQL["report_list_page"] = """SELECT o_orderkey, c_name, o_orderdate, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'O' AND o_orderpriority ILIKE '%high%' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
AND (c_name ILIKE '%mach%' OR c_mktsegment ILIKE '%mach%') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20"""


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("parent_id"), F.col("o_custkey").alias("chain"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.sha2(F.col("o_totalprice").cast("string"), 256).alias("file_hash"))


_REV = "r AS (SELECT o_orderkey AS id, o_custkey AS chain, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status, o_totalprice FROM orders)"


def latest_revision_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.leaves(_revisions(spark, sf_dir)).select("id", "chain", "parent_id")


SQL["latest_revision_only"] = f"WITH {_REV} SELECT id, chain, parent_id FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS c WHERE c.parent_id = r.id)"


def version_append_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is offered as the next revision of the order with the number before it."""
    existing = _revisions(spark, sf_dir)
    new = existing.select((F.col("id") + 10_000_000).alias("id"), (F.col("id") - 1).alias("parent_id"), "chain", F.when(F.col("id") % 2 == 0, F.col("file_hash")).otherwise(F.sha2(F.concat(F.lit("new"), F.col("id").cast("string")), 256)).alias("file_hash"))
    return versions.append_verdicts(new, existing).select("id", "parent_id", "chain", "reason")


SQL["version_append_guards"] = f"""WITH {_REV}, n AS (SELECT id + 10000000 AS id, id - 1 AS parent_id, chain, CASE WHEN id % 2 = 0 THEN o_totalprice END AS price FROM r)
SELECT n.id, n.parent_id, n.chain, CASE WHEN p.id IS NULL THEN 'parent_missing' WHEN p.status <> 'done' THEN 'parent_not_finished'
 WHEN EXISTS (SELECT 1 FROM r AS c WHERE c.parent_id = n.parent_id) THEN 'parent_not_latest' WHEN p.chain <> n.chain THEN 'other_application' WHEN n.price IS NOT NULL THEN 'file_known' END AS reason
FROM n LEFT JOIN r AS p ON p.id = n.parent_id"""


def version_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.timeline(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", F.col("revision").cast("long").alias("revision"), "o_orderstatus", "previous")


SQL["version_timeline"] = "SELECT o_custkey, o_orderkey, row_number() OVER w AS revision, o_orderstatus, lag(o_orderstatus) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def company_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return listing.roll_up(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_orderkey", "o_orderdate", F.col("o_orderstatus") == "F")


SQL["company_rollup"] = "SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS n, max(o_orderdate) FILTER (o_orderstatus = 'F') AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"


def active_uploaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.with_any(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


SQL["active_uploaders"] = "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


def pending_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return listing.pending(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), busy, "c_custkey", [F.col("c_acctbal").desc(), F.col("c_custkey")], 100)


SQL["pending_companies"] = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') ORDER BY c_acctbal DESC, c_custkey LIMIT 100"


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.histogram(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P", "X"])


SQL["status_histogram"] = "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in "FOPX") + " FROM orders GROUP BY 1"


def order_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return summaries.counters(table(spark, sf_dir, "orders"), total=F.lit(True), done=status == "F", open=status.isin("O", "P"), large=price >= 250_000, recent=F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp"))


SQL["order_counters"] = "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS open, count(*) FILTER (o_totalprice >= 250000) AS large, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-07-01') AS recent FROM orders"


def dashboard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, day = F.col("event_type"), F.to_date("ts")
    return summaries.counters(table(spark, sf_dir, "events"), today=day == F.lit("2024-01-30").cast("date"), in_progress=kind.isin("view", "click"), total=F.lit(True), with_issues=kind == "error")


SQL["dashboard_counters"] = "SELECT count(*) FILTER (ts::DATE = DATE '2024-01-30') AS today, count(*) FILTER (event_type IN ('view', 'click')) AS in_progress, count(*) AS total, count(*) FILTER (event_type = 'error') AS with_issues FROM events"


def daily_trend_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.daily_trend(table(spark, sf_dir, "events"), "ts", F.lit("2024-02-02").cast("date")).withColumn("day", F.col("day").cast("string"))


SQL["daily_trend_zero_fill"] = """SELECT d::DATE::VARCHAR AS day, strftime(d, '%m-%d') AS label, count(ts) AS n FROM generate_series(TIMESTAMP '2024-01-27', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) AS g(d) LEFT JOIN events ON ts::DATE = d::DATE GROUP BY d"""


def quota_per_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.quota(table(spark, sf_dir, "events"), "ts", ["event_type"], 70).withColumn("local_day", F.col("local_day").cast("string"))


SQL["quota_per_local_day"] = "SELECT event_type, (ts + INTERVAL 8 HOUR)::DATE::VARCHAR AS local_day, count(*) AS used, count(*) >= 70 AS exhausted FROM events GROUP BY 1, 2"


def latest_status_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest_status(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", "event_type")


SQL["latest_status_per_user"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.filtered(table(spark, sf_dir, "events"), {"event_type": "error"}, search=(["event_type", "props"], '"k": 1')).select("event_id", "user_id", "props")


SQL["audit_search"] = """SELECT event_id, user_id, props FROM events WHERE event_type = 'error' AND (event_type ILIKE '%"k": 1%' OR props ILIKE '%"k": 1%')"""


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = N.strict_number(N.json_object("props")["k"], "")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


SQL["event_properties"] = "SELECT event_type, count(k) AS n, sum(k) AS total, max(k) AS largest FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1"


def rule_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return summaries.tree_counts(rows, ["r_name", "n_name", "c_mktsegment"]).withColumn("depth", F.col("depth").cast("long"))


SQL["rule_tree_counts"] = "SELECT r_name, n_name, c_mktsegment, count(*) AS leaves, (3 - bit_count(grouping(r_name, n_name, c_mktsegment)::BIGINT))::BIGINT AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)"


def chronology_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("first"), F.max(F.to_date("l_shipdate")).alias("last"), F.collect_set("l_returnflag").alias("flags"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    completed = F.when(F.size("flags") == 1, F.array("first")).otherwise(F.array("first", "last"))
    state = verdicts.chronology(F.array(F.to_date("o_orderdate")), completed, F.array("last"))
    return rows.groupBy("o_orderstatus", state.alias("state")).agg(F.count("*").alias("n"))


SQL["chronology_check"] = """WITH l AS (SELECT l_orderkey, min(l_shipdate::DATE) AS f, max(l_shipdate::DATE) AS t, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY 1)
SELECT o_orderstatus, CASE WHEN t IS NULL OR (k <> 1 AND f <> t) THEN 'ambiguous' WHEN o_orderdate::DATE <= f AND f <= t THEN 'pass' ELSE 'manual_review' END AS state, count(*) AS n
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1, 2"""


def reconcile_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 10).alias("band")).distinct()
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 10).alias("band")).distinct()
    return matching.reconcile(a, b, ["nation", "band"])


SQL["reconcile_full_outer"] = """SELECT nation, band, CASE WHEN s AND r THEN 'matched' WHEN s THEN 'created_from_source' ELSE 'unmatched' END AS status
FROM (SELECT DISTINCT c_nationkey AS nation, floor(c_acctbal / 10)::BIGINT AS band, true AS s FROM customer) FULL JOIN (SELECT DISTINCT s_nationkey AS nation, floor(s_acctbal / 10)::BIGINT AS band, true AS r FROM supplier) USING (nation, band)"""


def prefix_compatible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer numbers, last digits first so that blocks are small; suppliers' are one to three digits shorter."""
    a = table(spark, sf_dir, "customer").select("c_custkey", F.reverse(F.substring("c_name", 10, 20)).alias("a"))
    b = table(spark, sf_dir, "supplier").select("s_suppkey", F.reverse(F.substring("s_name", 12, 20)).alias("b"))
    return matching.prefix_compatible(a, b, "a", "b")


SQL["prefix_compatible_names"] = """SELECT c_custkey, a, s_suppkey, b FROM (SELECT c_custkey, reverse(substring(c_name, 10, 20)) AS a FROM customer) JOIN (SELECT s_suppkey, reverse(substring(s_name, 12, 20)) AS b FROM supplier)
ON substring(a, 1, 6) = substring(b, 1, 6) AND length(a) >= 6 AND length(b) >= 6 AND abs(length(a) - length(b)) <= 8 AND (starts_with(a, b) OR starts_with(b, a))"""


def master_upsert_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers offered as master rows beside the customers: some blank, some with a customer's name."""
    existing = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))
    n = F.col("s_suppkey")
    name = F.when(n % 5 == 0, F.lit("  ")).when(n % 5 == 1, F.concat(F.lit(" Customer#"), F.lpad((n + 1).cast("string"), 9, "0"))).otherwise(F.col("s_name"))
    new = table(spark, sf_dir, "supplier").select((n * 2).alias("id"), name.alias("name"), F.when(n % 3 == 0, F.lit("unknown")).otherwise(F.lit("BUILDING")).alias("status"), F.when(n % 7 == 0, F.lit(" ")).otherwise(F.lit("register")).alias("source"))
    return governance.validated_upsert(new, existing, "id", "name", "status", "source")


SQL["master_upsert_validation"] = """WITH n AS (SELECT s_suppkey * 2 AS id, trim(CASE WHEN s_suppkey % 5 = 0 THEN '  ' WHEN s_suppkey % 5 = 1 THEN ' Customer#' || lpad((s_suppkey + 1)::VARCHAR, 9, '0') ELSE s_name END) AS name,
 CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE 'BUILDING' END AS status, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE 'register' END AS source FROM supplier)
SELECT n.id, name, status, CASE WHEN status <> 'unknown' THEN source END AS source,
 CASE WHEN name = '' THEN 'blank_name' WHEN EXISTS (SELECT 1 FROM customer WHERE c_name = name AND c_custkey <> n.id) THEN 'name_taken' WHEN status <> 'unknown' AND trim(source) = '' THEN 'no_source' END AS reason,
 CASE WHEN c.c_custkey IS NULL THEN 'insert' WHEN c_mktsegment <> status THEN 'update' ELSE 'keep' END AS action FROM n LEFT JOIN customer AS c ON c.c_custkey = n.id"""


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags of the lines of each customer's last two orders."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    orders = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("o_custkey", "r", F.col("o_orderkey").alias("l_orderkey"))
    issues = orders.join(table(spark, sf_dir, "lineitem"), "l_orderkey").select("o_custkey", "r", "l_returnflag", "l_linenumber")
    keys = ["o_custkey", "l_returnflag", "l_linenumber"]
    return compare.version_diff(issues.filter("r = 2").drop("r"), issues.filter("r = 1").drop("r"), keys)


SQL["version_diff"] = """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
i AS (SELECT DISTINCT o_custkey, r, l_returnflag, l_linenumber FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE r <= 2)
SELECT o_custkey, l_returnflag, l_linenumber, CASE WHEN count(*) = 2 THEN 'unresolved' WHEN max(r) = 2 THEN 'resolved' ELSE 'new' END AS status FROM i GROUP BY 1, 2, 3"""


def login_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return intake.lock_outs_batch(events, limit=2, minutes=60).withColumnRenamed("at", "locked_at")


SQL["login_lockout"] = """WITH RECURSIVE e AS (SELECT user_id, ts::TIMESTAMP AS at, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'error') AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::TIMESTAMP AS at, 0 AS fails, NULL::TIMESTAMP AS until, false AS hit FROM events UNION ALL
SELECT s.user_id, e.n, e.at, CASE WHEN coalesce(e.at < s.until, false) THEN s.fails WHEN e.failed AND s.fails < 1 THEN 1 ELSE 0 END,
 CASE WHEN coalesce(e.at < s.until, false) THEN s.until WHEN e.failed AND s.fails = 1 THEN e.at + INTERVAL 60 MINUTE END, NOT coalesce(e.at < s.until, false) AND e.failed AND s.fails = 1 FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, "at" AS locked_at, until FROM s WHERE hit"""


def retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), (F.col("o_orderkey") % 4).alias("attempt"))
    return intake.retry_eligible(tasks, "report_id", 2).select("report_id", "id", "action")


SQL["retry_candidates"] = """SELECT report_id, id, CASE WHEN s = 'F' THEN 'retry' ELSE 'requeue' END AS action FROM (SELECT o_custkey AS report_id, o_orderkey AS id, o_orderstatus AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
WHERE (s = 'F' AND id % 4 <= 2) OR s = 'P'"""

QUERIES = {
    f.__name__: f
    for f in (report_list_page, latest_revision_only, version_append_guards, version_timeline, company_rollup, active_uploaders, pending_companies, status_histogram, order_counters, dashboard_counters, daily_trend_zero_fill, quota_per_local_day, latest_status_per_user, audit_search, event_properties, rule_tree_counts, chronology_check, reconcile_full_outer, prefix_compatible_names, master_upsert_validation, version_diff, login_lockout, retry_candidates)
}

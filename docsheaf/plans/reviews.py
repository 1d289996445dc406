"""Queries of the selection and context operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.functions import normalize as N
from docsheaf.operators import context, selection, summaries, verdicts
from docsheaf.plans.tables import table
from docsheaf.plans.texts import part_key, part_size, part_type, parts, said

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def line_key() -> Column:
    """A key of its own for every line: order, line number, part and supplier repeat together only in equal rows."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_LINE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@registered("""WITH b AS (SELECT p_brand, list(DISTINCT p_type) AS types FROM part GROUP BY 1) SELECT p_brand, contains(lower(to_json(types)), 'mall","') OR contains(lower(to_json(types)), '"small') AS in_text,
len(list_filter(types, lambda t: contains(lower(t), 'romo'))) > 0 AS in_items FROM b""")
def json_array_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = parts(spark, sf_dir).groupBy("p_brand").agg(F.collect_set("p_type").alias("types"))
    return types.select("p_brand", selection.in_json_array("types", '"SMALL').alias("in_text"), selection.has_item("types", "ROMO").alias("in_items"))


@registered("""SELECT p_brand, count(*) AS all_rules, count(*) FILTER (p_size % 3 = 0 AND p_partkey % 2 = 0) AS active, count(*) FILTER (p_size % 3 = 0) AS verified FROM part GROUP BY 1""")
def governed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = parts(spark, sf_dir).select("p_brand", F.when(part_size() % 3 == 0, "verified").when(part_size() % 3 == 1, "draft").alias("verification_status"), (part_key() % 2 == 0).cast("string").alias("enabled_for_review"))
    n = lambda df, name: df.groupBy("p_brand").agg(F.count("*").alias(name))
    out = n(selection.governed(rules.drop("verification_status", "enabled_for_review")), "all_rules").join(n(selection.governed(rules), "active"), "p_brand", "left").join(n(selection.governed(rules.drop("enabled_for_review")), "verified"), "p_brand", "left")
    return out.fillna(0)


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 2) AND NOT (p_size % 5 = 0) THEN 'kept' ELSE 'removed' END AS outcome FROM part""")
def route_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = parts(spark, sf_dir).select("p_partkey", F.when(part_key() % 4 == 0, "砷含量").when(part_key() % 4 == 2, "材料类型").otherwise(part_type()).alias("item"), F.when(part_size() % 5 == 0, "导体电阻").alias("note"))
    kept, removed = selection.whitelisted(entries, ["item", "note"], "砷|元素|限用物质|材料类型", "导体|电阻|电压")
    return kept.select("p_partkey", F.lit("kept").alias("outcome")).unionByName(removed.select("p_partkey", F.lit("removed").alias("outcome")))


@registered(f"""WITH f AS (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag = 'N' AND l_linenumber % 2 = 0 AS extra FROM lineitem),
c AS (SELECT {_LINE} AS id, l_orderkey, l_suppkey, l_linestatus FROM lineitem)
SELECT (CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.l_orderkey = c.l_orderkey AND f.l_suppkey = c.l_suppkey AND f.extra) THEN 'pass' ELSE 'fail' END) AS verdict, count(*) AS n, (SELECT count(*) FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linenumber % 2 = 0)) AS findings FROM c GROUP BY 1""")
def extra_passed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line is a finding of its order, and a check of the same supplier's test."""
    name = said("试验 ", F.col("l_suppkey"), "号")
    findings = lines(spark, sf_dir).select("l_orderkey", name.alias("item"), F.when(F.col("l_linenumber") % 2 == 0, "实测 P").otherwise("实测 F").alias("reported"), F.when(F.col("l_returnflag") == "N", "标准不要求").otherwise("应改").alias("should_be"), F.lit("").alias("standard"))
    checks = lines(spark, sf_dir).select("l_orderkey", line_key().alias("id"), F.lit("").alias("category"), name.alias("item"), F.lit("fail").alias("verdict"), F.lit("").alias("note"))
    kept, flipped = selection.without_extra_passed(findings, checks, ["l_orderkey"])
    return flipped.groupBy("verdict").agg(F.count("*").alias("n")).join(kept.agg(F.count("*").alias("findings")), how="cross")


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'signature' WHEN p_size % 2 = 0 THEN 'generic' END AS reason FROM part""")
def suppressed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("p_partkey", F.when(part_key() % 4 == 0, "审核人签字核对").when(part_key() % 4 == 1, "签名").otherwise("人员").alias("item"), F.when(part_size() % 2 == 0, "是否").otherwise("应为 1").alias("action"))
    kept, log = selection.suppressed(rows, [("signature", selection.personnel_signature(F.col("item"), F.lit(""))), ("generic", F.contains("action", F.lit("是否")))])
    return kept.select("p_partkey", F.lit(None).cast("string").alias("reason")).unionByName(log.select("p_partkey", "reason"))


@registered("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'scope' WHEN 2 THEN 'result' WHEN 3 THEN 'shape' WHEN 4 THEN 'fields' END AS error, CASE WHEN o_orderkey % 5 = 0 THEN 8 ELSE 0 END::BIGINT AS checks, CASE WHEN o_orderkey % 5 = 0 THEN 'n' || o_custkey END AS note FROM orders""")
def review_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    one = lambda scope, result, item: '{"scope": "' + scope + '", "item": "' + item + '", "result": "' + result + '", "note": "n'
    good = F.concat(F.lit('{"logic_checks": [' + one("Date_Logic ", "warning", "抗张")), F.lit('x"}, '), F.repeat(said(one("date_logic", "WARNING", "x"), F.col("o_custkey"), '"}, '), 9), said(one("date_logic", "warning", "y"), F.col("o_custkey"), '"}]}'))
    bad = {1: '{"logic_checks": [' + one("other", "warning", "x") + '"}]}', 2: '{"logic_checks": [' + one("date_logic", "pass", "x") + '"}]}', 3: '{"logic_checks": [], "more": 1}', 4: '{"logic_checks": [{"scope": "date_logic", "item": "x", "result": "warning"}]}'}
    payload = F.coalesce(*[F.when(key % 5 == k, F.lit(v)) for k, v in bad.items()], good)
    docs = orders(spark, sf_dir).select("o_orderkey", payload.alias("payload"))
    checks, errors = selection.reviewed_payloads(docs, "o_orderkey", "payload")
    per = checks.groupBy("o_orderkey").agg(F.count("*").alias("checks"), F.min("note").alias("note"))
    return docs.select("o_orderkey").join(errors, "o_orderkey", "left").join(per, "o_orderkey", "left").fillna(0, ["checks"])


@registered("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3),
t AS (SELECT o_custkey, string_agg('order ' || o_orderkey, chr(10) ORDER BY rank) AS t FROM r GROUP BY 1) SELECT o_custkey, CASE WHEN length(t) > 25 THEN left(t, 25) || '...' ELSE t END AS context FROM t ORDER BY o_custkey""")
def capped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = selection.capped(orders(spark, sf_dir), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", said("order ", F.col("o_orderkey")).alias("t")))), lambda x: x["t"]), "\n")
    return top.groupBy("o_custkey").agg(selection.capped_text(text, 25, "...").alias("context"))


@registered("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 50")
def names_without_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first fifty."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("name"))
    return selection.ordered_by_name(names, "name", "c_custkey").limit(50)


@registered("""WITH e AS (SELECT o_custkey, max({'r': o_orderkey % 7, 'k': o_orderkey}) AS m FROM orders GROUP BY 1) SELECT c_custkey, m.k AS follows, coalesce(m.r + 1, 0)::BIGINT AS next_revision FROM customer LEFT JOIN e ON o_custkey = c_custkey""")
def revision_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 7).alias("revision"), F.col("o_orderkey").alias("id"))
    return selection.next_revisions(table(spark, sf_dir, "customer").select("c_custkey"), existing, "c_custkey", "revision", "id").select("c_custkey", "follows", F.col("next_revision").cast("long").alias("next_revision"))


@registered("SELECT p_partkey, p_partkey % 2 = 0 AND p_size % 3 <> 0 AND p_partkey % 5 <> 0 AND p_size % 7 <> 0 AS valid FROM part")
def cache_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = lambda c: F.when(c, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    df = parts(spark, sf_dir).select("p_partkey", F.when(part_key() % 2 == 0, "enforce").alias("mode"), F.lit("ok").alias("model_status"), strings(part_size() % 3 != 0).alias("outbound_findings"), F.lit(False).alias("outbound_blocked"), F.when(part_key() % 5 != 0, part_type()).otherwise(" ").alias("external_text"), part_type().alias("sanitized_text"), F.create_map(F.lit("company"), part_size(), F.lit("application_no"), F.when(part_size() % 7 == 0, -1).otherwise(0)).alias("replacement_counts"))
    return df.select("p_partkey", selection.valid_cache(df).alias("valid"))


@registered("SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N')::BIGINT AS issues FROM lineitem GROUP BY 1")
def nested_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("l_returnflag") == "R", "must_fix").when(F.col("l_returnflag") == "A", "suggestion").otherwise("ok")
    samples = lines(spark, sf_dir).groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(F.struct(severity.alias("severity"))).alias("items"))
    reports = samples.groupBy("l_orderkey").agg(F.collect_list(F.struct("items")).alias("samples"))
    return reports.select("l_orderkey", selection.issue_count("samples").cast("long").alias("issues"))


@registered("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS "R", count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS other, count(*) AS batches, sum(l_quantity) AS l_quantity, count(*) FILTER (l_discount > 0.05) AS cut FROM lineitem GROUP BY 1""")
def evidence_and_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).withColumn("cut", F.col("l_discount") > 0.05)
    return selection.status_counts(df, ["l_orderkey"], "l_returnflag", ["R", "A"]).join(selection.batch_totals(df, ["l_orderkey"], ["l_quantity"], ["cut"]), "l_orderkey")


@registered("""WITH m AS (SELECT p_partkey AS model_id, p_brand AS series_id FROM part), x AS (SELECT o_orderkey, p_partkey AS model_id, p_brand AS series_id FROM orders JOIN part ON p_partkey = o_custkey),
w AS (SELECT x.o_orderkey, l_suppkey AS method FROM x JOIN lineitem ON l_partkey = x.model_id WHERE l_linestatus = 'O' UNION SELECT x.o_orderkey, s_suppkey FROM x JOIN lineitem ON l_partkey = x.model_id JOIN supplier ON s_nationkey = l_linenumber WHERE l_linestatus = 'O' AND l_returnflag <> 'N'),
p AS (SELECT w.o_orderkey, method, c_custkey AS id, c_mktsegment, floor(c_acctbal) AS priority FROM w JOIN customer ON c_nationkey = method WHERE c_acctbal > 0 AND (c_custkey % 3 <> 0 OR c_custkey = (SELECT o_custkey FROM orders AS o WHERE o.o_orderkey = w.o_orderkey))),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY o_orderkey, method, c_mktsegment ORDER BY priority DESC, id) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY priority DESC, id) AS rank FROM f QUALIFY rank <= 5)
SELECT o_orderkey, string_agg('- 方法' || method || ' ' || c_mktsegment || ' =mm', chr(10) ORDER BY rank) AS context FROM k GROUP BY 1""")
def rule_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's part as its model: lines are the matrix, suppliers the methods, customers the parameters."""
    chosen = orders(spark, sf_dir).join(parts(spark, sf_dir).select(F.col("p_partkey").alias("o_custkey"), F.col("p_brand").alias("series_id")), "o_custkey").select("o_orderkey", F.col("o_custkey").alias("model_id"), "series_id")
    matrix = lines(spark, sf_dir).select(F.col("l_partkey").alias("model_id"), F.col("l_suppkey").alias("test_method_id"), F.col("l_linenumber").alias("test_item_id"), F.when(F.col("l_returnflag") == "N", "not_applicable").otherwise("required").alias("applicability_status"), F.when(F.col("l_linestatus") == "O", "verified").alias("verification_status"))
    methods = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("test_item_id"))
    customer = table(spark, sf_dir, "customer")
    rules = customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("test_method_id"), F.col("c_mktsegment").alias("parameter_name"), F.lit("=").alias("operator"), F.lit("").alias("parameter_value"), F.lit("mm").alias("unit"), F.floor("c_acctbal").alias("priority"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("model_id"), F.lit(None).cast("string").alias("series_id"), F.when(F.col("c_acctbal") > 0, "true").otherwise("false").alias("enabled_for_review"))
    keys, choices = context.shared_models(chosen, "o_orderkey")
    texts = context.context_text(context.rule_parameters(choices, matrix, methods, rules, "choice", 5), "choice")
    return keys.join(texts, "choice").select("o_orderkey", "context")


@registered("""WITH h AS (SELECT o_orderkey, p_partkey, CASE WHEN contains(p_name, ' ') THEN 130 ELSE 100 END AS s, p_name FROM orders JOIN part ON p_partkey IN (o_custkey, o_custkey + 1)),
a AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h AS o WHERE o.o_orderkey = h.o_orderkey AND length(o.p_name) > length(h.p_name) AND contains(upper(o.p_name), upper(h.p_name)))),
n AS (SELECT DISTINCT a.o_orderkey, q.p_partkey AS model_id, a.s FROM a JOIN part AS q ON upper(q.p_name) = upper(a.p_name)), b AS (SELECT *, max(s) OVER (PARTITION BY o_orderkey) AS top FROM n)
SELECT o_orderkey, model_id, s::BIGINT AS score, row_number() OVER (PARTITION BY o_orderkey ORDER BY s DESC, model_id) AS rank FROM b WHERE s >= top - 15 QUALIFY rank <= 4""")
def chosen_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders name the part of their customer's number and the next one; names repeat, so several parts may answer."""
    names = parts(spark, sf_dir).select("p_partkey", "p_name")
    texts = orders(spark, sf_dir).select("o_orderkey", F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 1)).alias("p_partkey")).join(names, "p_partkey").select("o_orderkey", F.lower("p_name").alias("token"))
    models = names.select(F.col("p_partkey").alias("model_id"), F.col("p_name").alias("code"), F.lit(None).cast("array<string>").alias("aliases"))
    return context.chosen_models(texts, models, "o_orderkey").select("o_orderkey", "model_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@registered("""WITH s AS (SELECT p_partkey, 'core_count' AS field, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 1 END::VARCHAR AS value, CASE WHEN p_partkey % 2 = 0 THEN 'sample.explicit' ELSE 'sample.spec' END AS source FROM part UNION ALL
SELECT p_partkey, 'nominal_section_mm2', '1.5', 'sample.spec' FROM part UNION ALL SELECT p_partkey, 'shape', CASE p_partkey % 3 WHEN 0 THEN 'flat' ELSE 'round' END, 'sample.text' FROM part WHERE p_partkey % 3 < 2 UNION ALL
SELECT p_partkey, 'outer_diameter_mm', p_size || '.5', 'checks.reported' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'insulated_core_diameter_mm', p_size || '.0', 'checks.reported' FROM part WHERE p_partkey % 4 = 1 UNION ALL
SELECT p_partkey, 'short_axis_mm', p_size || '.0', 'checks.reported' FROM part WHERE p_partkey % 4 = 2 UNION ALL SELECT p_partkey, 'shape', 'flat', 'checks.reported' FROM part WHERE p_partkey % 4 = 2) SELECT * FROM s""")
def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    samples = parts(spark, sf_dir).select("p_partkey", F.when(part_key() % 2 == 0, part_size().cast("string")).alias("core_count"), F.lit("about 2").alias("section"), said(part_size() + 1, "×1.5 mm²").alias("spec"), none.alias("outer_diameter_mm"), F.when(part_key() % 3 == 1, "圆形").alias("shape"), F.when(part_key() % 3 == 0, "YZW (B)").otherwise("X").alias("model"))
    item = F.when(part_key() % 4 == 0, "护套外径").when(part_key() % 4 == 1, "绝缘线芯外径").when(part_key() % 4 == 2, "外形尺寸").otherwise("外径")
    reported = F.when(part_key() % 4 == 0, said(part_size(), ".5 mm")).when(part_key() % 4 == 1, said(part_size())).when(part_key() % 4 == 2, said(part_size() + 3, "×", part_size())).otherwise("1 和 2 和 3")
    return context.condition_facts(samples, parts(spark, sf_dir).select("p_partkey", item.alias("item"), reported.alias("reported")), "p_partkey")


@registered("""SELECT p_partkey, 'P-' || p_brand AS profile_code, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE (p_size >= 20)::VARCHAR END AS state FROM part WHERE p_brand < 'Brand#3'""")
def profile_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = parts(spark, sf_dir).select("p_partkey", said(" ", F.lower("p_brand")).alias("model"))
    brands = parts(spark, sf_dir).select(F.col("p_brand").alias("model_code")).distinct()
    bindings = brands.withColumn("profile_code", said("P-", F.col("model_code"))).withColumn("verification_status", F.when(F.col("model_code") < "Brand#3", "verified"))
    facts = parts(spark, sf_dir).select("p_partkey", F.when(part_key() % 5 != 0, part_size()).alias("core_count"))
    return context.profile_states(samples, bindings, bindings.select("profile_code"), facts, "p_partkey", {"op": ">=", "field": "core_count", "value": 20})


@registered("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 2 THEN '' ELSE '存续' END AS raw_status FROM customer)
SELECT c_custkey, name, raw_status, CASE WHEN raw_status <> '' THEN 'active' END AS operating_status, CASE WHEN name IS NULL THEN 'name_not_found' WHEN raw_status = '' THEN 'no_status' END AS reason,
(SELECT count(*) FROM r WHERE raw_status <> '') AS ok FROM r""")
def registry_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    record = said('{"companyName": "', F.when(key % 4 == 3, "x").otherwise(name), '", "regStatus": "', F.when(key % 4 == 2, " ").otherwise("存续"), '"}')
    payload = F.when(key % 4 == 0, record).when(key % 4 == 1, said('{"data": [{"name": "other", "status": "注销"}, ', record, "]}")).otherwise(said('{"items": [', record, "]}"))
    answers = table(spark, sf_dir, "customer").select("c_custkey", payload.alias("payload"), said(" ", name).alias("keyword"))
    found = context.registry_answers(answers, "c_custkey", "payload", "keyword")
    return found.join(context.enrichment_totals(found).select("ok"), how="cross")


@registered("""WITH a AS (SELECT o_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS u FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN n = 1 THEN u END AS owner, o_orderstatus <> 'F' AS creates FROM orders JOIN a USING (o_orderkey)""")
def created_and_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners from the lines that name an order; orders that no finished one stands for are created once."""
    audit = lines(spark, sf_dir).select(F.col("l_suppkey").alias("user_id"), said("上传报告 ID：", F.col("l_orderkey"), " ok").alias("detail"))
    reports = orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("owner"))
    owned = context.owners_from_audit(reports, audit, "o_orderkey", "owner", r"报告\s*ID\s*[：:]\s*(\d+)")
    done = orders(spark, sf_dir).filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source_id"))
    fresh = context.created_once(reports.unionAll(reports), done, "o_orderkey", "source_id").select("o_orderkey", F.lit(True).alias("creates"))
    return owned.join(fresh, "o_orderkey", "left").fillna(False, ["creates"])


@registered("""WITH c AS (SELECT l_suppkey, 'P' || l_partkey % 40 AS project, l_linenumber AS seg, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'fail' END AS v, l_quantity > 30 AS e, CASE WHEN l_linenumber % 3 = 0 THEN '未提供记录' WHEN l_linenumber % 3 = 1 THEN 'q' || (l_quantity % 5)::INT END AS reported FROM lineitem),
g AS (SELECT coalesce((SELECT CASE WHEN p_size % 2 = 0 THEN 'merge_policy' ELSE 'other' END FROM part WHERE p_partkey % 3 = 0 AND p_size <> 50 AND p_size % 2 = 0 ORDER BY p_size DESC, p_partkey DESC LIMIT 1) = 'merge_policy', false) AS active),
m AS (SELECT l_suppkey, project AS item, coalesce(reported, '') AS reported, list_sort(list(DISTINCT seg)) AS segs FROM c WHERE NOT coalesce(regexp_matches(reported, '未提供'), false) OR NOT EXISTS (SELECT 1 FROM c AS d WHERE d.l_suppkey = c.l_suppkey AND d.project = c.project AND d.e) GROUP BY 1, 2, 3),
k AS (SELECT l_suppkey, project, list_sort(list(DISTINCT seg)) AS segs FROM (SELECT *, bool_or(e) OVER (PARTITION BY l_suppkey, project) AS has FROM c) WHERE e OR NOT has GROUP BY 1, 2 HAVING bool_or(v = 'pass') AND bool_or(v = 'fail'))
SELECT l_suppkey, item, reported, array_to_string(segs, ',') AS segments FROM m, g WHERE active UNION ALL SELECT l_suppkey, project || '分段结论冲突', '不同分段同时出现符合与不符合结论', array_to_string(segs, ',') FROM k, g WHERE active
UNION ALL SELECT l_suppkey, project, coalesce(reported, ''), seg::VARCHAR FROM c, g WHERE NOT active""")
def merge_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as checks and findings of a supplier's projects, line numbers as segments; parts as versions of the rule."""
    kind, number = F.col("l_returnflag"), F.col("l_linenumber")
    reported = F.when(number % 3 == 0, "未提供记录").when(number % 3 == 1, said("q", (F.col("l_quantity") % 5).cast("int")))
    rows = lines(spark, sf_dir).select("l_suppkey", said("P", F.col("l_partkey") % 40).alias("project"), number.alias("seg"), F.when(kind == "A", "pass").when(kind == "R", "fail").alias("verdict"), (F.col("l_quantity") > 30).alias("e"), reported.alias("reported"))
    empty = F.lit(None).cast("string")
    findings = rows.select("l_suppkey", "project", "seg", F.col("project").alias("item"), "reported", empty.alias("should_be"), empty.alias("standard"), empty.alias("severity"))
    status = F.when(part_size() == 50, "archived").otherwise("active")
    rules = parts(spark, sf_dir).filter((part_key() % 3 == 0) & (part_size() % 2 == 0)).select(F.lit("merge").alias("code"), status.alias("status"), part_size().alias("version"), part_key().alias("id"), F.lit("merge_policy").alias("kind"))
    out = verdicts.merge_policy(findings, rows, rules, "merge", ["l_suppkey"], "project", "seg", "verdict", F.col("e"), F.regexp_like("reported", F.lit("未提供")))
    return out.select("l_suppkey", "item", "reported", F.array_join(F.col("segments").cast("array<string>"), ",").alias("segments"))


_NAMED, _TASKS = r"报告ID[：:]\s*(\d+)", r"任务\s*(S\d+)"


@registered(f"""WITH a AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN '报告ID：' || l_orderkey || ' 已同步' WHEN 1 THEN '报告ID: ' || l_orderkey || ' 任务S' || l_suppkey WHEN 2 THEN '报告ID：' || l_orderkey || '、报告ID：' || l_orderkey + 1 || ' 任务 S' || l_suppkey || '，任务S' || l_suppkey
WHEN 3 THEN CASE WHEN l_returnflag <> 'R' THEN '报告ID ' || l_orderkey || ' 任务S' || l_suppkey END END AS detail FROM lineitem),
n AS (SELECT detail, unnest(regexp_extract_all(detail, '{_NAMED}', 1))::BIGINT AS k FROM a),
t AS (SELECT k, unnest(regexp_extract_all(detail, '{_TASKS}', 1)) AS task FROM n),
o AS (SELECT k, min(task) AS task FROM t GROUP BY 1 HAVING count(DISTINCT task) = 1)
SELECT o_orderkey, task FROM orders LEFT JOIN o ON k = o_orderkey""")
def tasks_from_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines of four spellings: without a task, with one, with two reports and a repeated task, and a damaged or missing text."""
    order, kind = F.col("l_orderkey"), F.col("l_linenumber") % 4
    task = said("任务S", F.col("l_suppkey"))
    damaged = F.when(F.col("l_returnflag") != "R", said("报告ID ", order, " ", task))
    double = said("报告ID：", order, "、报告ID：", order + 1, " 任务 S", F.col("l_suppkey"), "，", task)
    detail = F.when(kind == 0, said("报告ID：", order, " 已同步")).when(kind == 1, said("报告ID: ", order, " ", task)).when(kind == 2, double).when(kind == 3, damaged)
    return context.tasks_from_audit(orders(spark, sf_dir).select("o_orderkey"), lines(spark, sf_dir).select(detail.alias("detail")), "o_orderkey", _NAMED, _TASKS)


@registered("""WITH v AS (SELECT c_custkey, c_nationkey, c_name FROM customer WHERE c_acctbal > 9000 ORDER BY c_custkey LIMIT 1)
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_corrections, (SELECT count(*) FROM part WHERE p_size < 10) AS draft_rules, (SELECT count(*) FROM part WHERE p_size > 40) AS regression_cases,
(SELECT c_custkey FROM v) AS active_id, coalesce((SELECT 'V' || c_nationkey FROM v), '基础版') AS iteration_version, coalesce((SELECT c_name FROM v), '') AS iteration_name, coalesce((SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'K' || c_nationkey END FROM v), 'unknown') AS knowledge_version,
o_orderkey AS run_id, o_custkey AS run_total, o_custkey // 2 AS run_passed, o_custkey - o_custkey // 2 AS run_failed FROM orders ORDER BY o_orderkey DESC LIMIT 1""")
def governance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as corrections and runs, parts as rules and cases, customers as versions."""
    corrections = orders(spark, sf_dir).select(F.when(F.col("o_orderstatus") == "P", "pending").otherwise("closed").alias("status"))
    rules = parts(spark, sf_dir).select(F.when(part_size() < 10, "draft").otherwise("enabled").alias("status"), (part_size() > 40).alias("enabled"))
    nation = F.col("c_nationkey")
    versions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), nation.alias("version_no"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 9000, "active").otherwise("archived").alias("status"), F.when(nation % 2 == 0, said("K", nation)).otherwise(" ").alias("knowledge_version"))
    half = F.floor(F.col("o_custkey") / 2)
    runs = orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("total"), half.alias("passed"), (F.col("o_custkey") - half).alias("failed"))
    return summaries.governance_summary(corrections, rules, rules, versions, runs)


@registered("""WITH s AS (SELECT p_brand, p_size, count(*) AS n, min(p_type) AS t, min(p_partkey) AS id FROM part GROUP BY 1, 2),
j AS (SELECT r.p_partkey, CASE WHEN n IS NULL THEN 'unbound' WHEN n > 1 THEN 'ambiguous' WHEN r.p_type <> t THEN 'category_conflict' ELSE 'bound' END AS status, id FROM (SELECT p_partkey, p_brand, p_size + p_partkey % 2 AS p_size, p_type FROM part) AS r LEFT JOIN s ON s.p_brand = r.p_brand AND s.p_size = r.p_size)
SELECT p_partkey, status, CASE WHEN status = 'bound' THEN id END AS scope_id FROM j""")
def scope_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = parts(spark, sf_dir).select("p_partkey", "p_brand", (part_size() + part_key() % 2).cast("int").alias("p_size"), "p_type")
    scopes = parts(spark, sf_dir).select("p_brand", "p_size", "p_type", part_key().alias("scope_id"))
    return context.bound_scope(reports, scopes, ["p_brand", "p_size"], "p_type").select("p_partkey", "status", "scope_id")


@registered("""WITH g AS (SELECT l_orderkey, l_returnflag, list_sort(list(DISTINCT l_linenumber)) AS pages, min(l_partkey) AS id FROM lineitem GROUP BY 1, 2),
x AS (SELECT l_orderkey, pages, count(*) AS n, min(id) AS id FROM g GROUP BY 1, 2)
SELECT g.l_orderkey, g.l_returnflag, CASE WHEN n = 1 THEN x.id END AS entry_id, CASE WHEN (SELECT count(*) FROM g AS o WHERE o.l_orderkey = g.l_orderkey AND o.l_returnflag = 'R') = 1 AND g.l_returnflag = 'R' THEN false ELSE true END AS created FROM g LEFT JOIN x USING (l_orderkey, pages)""")
def registry_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = lines(spark, sf_dir).groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_linenumber").alias("pages"), F.min("l_partkey").alias("entry_id"))
    batch = context.aligned_registry(groups.drop("entry_id"), groups, ["l_orderkey"], "pages")
    specimens = groups.filter("l_returnflag = 'R'").select("l_orderkey", "l_returnflag", F.col("entry_id").alias("specimen_id"))
    owned = context.owned_supplements(groups.select("l_orderkey", "l_returnflag"), specimens, ["l_orderkey"], "l_returnflag")
    return batch.join(owned.select("l_orderkey", "l_returnflag", "created"), ["l_orderkey", "l_returnflag"]).select("l_orderkey", "l_returnflag", "entry_id", "created")


@registered("""WITH s AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS id FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, k AS page, CASE WHEN n = 1 THEN id END AS specimen_id, CASE WHEN n IS NULL THEN 'no_owner' WHEN n > 1 THEN 'several_owners' END AS reason FROM orders CROSS JOIN (VALUES (1), (4)) AS v(k) LEFT JOIN s ON l_orderkey = o_orderkey AND l_linenumber = k""")
def attached_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = orders(spark, sf_dir).select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(4))).alias("page"))
    specimens = lines(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("specimen_id"))
    good, skipped = context.attached(seen, specimens, ["o_orderkey", "page"])
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(skipped.withColumn("specimen_id", F.lit(None).cast("long")))


@registered("""WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag) FILTER (l_linenumber <= 2)) AS c, list_sort(list(DISTINCT l_returnflag) FILTER (l_linenumber > 2)) AS h FROM lineitem GROUP BY 1),
r AS (SELECT *, coalesce(len(c), 0) AS nc, coalesce(len(h), 0) AS nh FROM g), s AS (SELECT *, CASE WHEN nc > 1 THEN 'several_covers' WHEN nc = 1 AND nh > 0 AND (nh > 1 OR h[1] <> c[1]) THEN 'conflict' WHEN nc = 0 AND nh <> 1 THEN 'no_identity' END AS reason FROM r)
SELECT l_orderkey, CASE WHEN reason IS NULL THEN coalesce(c[1], h[1]) END AS identity, reason FROM s""")
def identity_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = F.col("l_linenumber") <= 2
    rows = lines(spark, sf_dir).select("l_orderkey", F.when(cover, F.col("l_returnflag")).alias("cover"), F.when(~cover, F.col("l_returnflag")).alias("header"))
    return context.checked_identity(rows, "l_orderkey", "cover", "header")


_GATES = "['unknown', 'invalid_status', 'missing_reference', 'rewritten_value', 'role_collision', 'cross_row_or_table', 'not_single_explicit_number', 'reference_valid_only']"


@registered(f"""SELECT p_partkey, ({_GATES})[p_partkey % 8 + 1] AS gate, CASE WHEN p_partkey % 8 = 7 THEN p_size || '.5' ELSE 'old' END AS value, CASE WHEN p_partkey % 8 = 7 THEN 'old' END AS prior FROM part""")
def reference_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table row for every part (label, unit, result), one more row, and proposals that break one rule each."""
    kind = part_key() % 8
    value = F.when(kind == 6, said(part_size(), ".5 mm")).otherwise(said(part_size(), ".5"))
    cell = lambda name, row, text: F.struct(F.lit(name).alias("cell_id"), F.lit(0).alias("table_no"), F.lit(row).alias("row_no"), text.alias("text"))
    cells = parts(spark, sf_dir).select("p_partkey", F.explode(F.array(cell("r", 0, value), cell("l", 0, F.lit("厚度")), cell("u", 0, F.lit("mm")), cell("u2", 1, F.lit("mm")))).alias("c")).select("p_partkey", "c.*")
    status = F.when(kind == 0, "unknown").when(kind == 1, "found").otherwise("candidate")
    unit = F.when(kind == 2, "x").when(kind == 4, "l").when(kind == 5, "u2").otherwise("u")
    items = parts(spark, sf_dir).select("p_partkey", status.alias("status"), F.lit("r").alias("result_cell"), F.lit("l").alias("label_cell"), unit.alias("unit_cell"), F.when(kind == 3, "1").otherwise(value).alias("raw_value"))
    gated = context.reference_gate(items, cells, ["p_partkey"])
    taken = context.adopted(parts(spark, sf_dir).select("p_partkey", F.lit("old").alias("value")), gated, ["p_partkey"])
    return gated.select("p_partkey", "gate").join(taken, "p_partkey")


@registered("""SELECT p_partkey, p_partkey % 3 = 0 AS supported FROM part WHERE p_size % 2 = 0""")
def character_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of weak confidence over single characters: the same text, another one, and a hidden one."""
    text = said("温度 ", part_size(), " °C")
    native = F.when(part_key() % 3 == 1, said("温度", part_size() + 1, "℃")).otherwise(said("温度", part_size(), "℃"))
    box = [F.lit(float(v)).alias(n) for n, v in (("left", 0), ("right", 100), ("top", 0), ("bottom", 10))]
    cells = parts(spark, sf_dir).select("p_partkey", part_key().alias("cell_id"), text.alias("text"), F.when(part_size() % 2 == 0, 0.8).otherwise(0.99).alias("confidence"), *box)
    letters = parts(spark, sf_dir).select("p_partkey", F.posexplode(F.split(native, "")).alias("x", "char"), (part_key() % 3 == 2).alias("hidden")).select("p_partkey", F.col("x").cast("double").alias("x"), F.lit(5.0).alias("y"), "char", "hidden")
    return context.supported_cells(cells, letters, ["p_partkey"]).select("p_partkey", "supported")


_ROUTES = ["arsenic", "spectrum", "type_test", "mixed_scope", "no_evidence", "category_conflict", "special_text_in_type_test"]


@registered(f"""SELECT p_partkey, CASE WHEN p_partkey % 7 < 3 THEN ({_ROUTES})[p_partkey % 7 + 1] END AS category, CASE WHEN p_partkey % 7 >= 3 THEN ({_ROUTES})[p_partkey % 7 + 1] END AS error FROM part""")
def routed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["砷元素快检分析报告", "红外光谱分析报告", "安全型式试验报告", "砷元素快检报告 导体电阻", "普通文字", "砷元素快检报告", "砷元素快检报告"]
    k = (part_key() % 7 + 1).cast("int")
    bound = F.when(part_key() % 7 == 5, "spectrum").when(part_key() % 7 == 6, "type_test")
    reports = parts(spark, sf_dir).select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, texts)), k), part_type()).alias("text"), bound.alias("bound"))
    special = {"spectrum": "(?:红外(?:光谱)?|图谱|光谱)(?:分析|检测)?报告", "arsenic": "砷元素(?:快检)?(?:分析)?报告"}
    return context.routed(reports, "text", special, "导体电阻|绝缘电阻", "型式试验报告", "bound").select("p_partkey", "category", "error")


@registered("""SELECT p_partkey, p_size::DOUBLE AS temperature, 4::DOUBLE AS hours, 3.5::DOUBLE AS force FROM part WHERE p_partkey % 4 = 0""")
def condition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one heading and its three conditions; with a line too much, one stated twice, and two headings."""
    good = ["表", "高温压力-压痕深度-中间值", "试验条件：温度", "时间4h", "", "施加荷载：3.5N", "低温弯曲", "时间9h"]
    more = {0: good, 1: good[:4] + ["注意"] + good[4:], 2: good[:4] + ["时间5h"] + good[4:], 3: good[:2] + good[1:]}
    rows = F.coalesce(*[F.when(part_key() % 4 == k, F.array(*[said(x, "(", part_size(), "±2)℃") if x.endswith("温度") else F.lit(x) for x in v])) for k, v in more.items()])
    page = parts(spark, sf_dir).select("p_partkey", F.posexplode(rows).alias("pos", "line"))
    patterns = {"temperature": r"(?:试验条件[:：])?温度[（(]?([+-]?\d+(?:\.\d+)?)(?:±2)?[）)]?℃", "hours": r"时间([+-]?\d+(?:\.\d+)?)h", "force": r"施加(?:压力|荷载|负荷)[:：]?([+-]?\d+(?:\.\d+)?)N"}
    return context.condition_records(page, ["p_partkey"], "pos", "(?:护套)?高温压力[-—－]压痕深度[-—－]中间值", patterns, "低温|热冲击|热稳定|老化|失重|注[:：]")


@registered("""SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4 AND count(DISTINCT (CASE WHEN l_linenumber <= 2 THEN 'before' ELSE 'after' END, CASE WHEN l_linenumber % 2 = 0 THEN 'tensile' ELSE 'elongation' END)) = 4 AND max(l_linenumber) <= 4""")
def complete_row_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose four lines are two stages of two fields; further lines are another stage."""
    n = F.col("l_linenumber")
    rows = lines(spark, sf_dir).select("l_orderkey", F.when(n <= 2, "before").when(n <= 4, "after").otherwise("other").alias("stage"), F.when(n % 2 == 0, "tensile").otherwise("elongation").alias("field"))
    return context.complete_row_sets(rows, ["l_orderkey"], "stage", "field", ["before", "after"], ["tensile", "elongation"])


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unresolved' WHEN p_size BETWEEN 30 AND 70 AND p_partkey % 2 = 1 THEN 'failed_within_range' WHEN NOT p_size BETWEEN 30 AND 70 AND p_partkey % 2 = 0 THEN 'passed_out_of_range' ELSE 'consistent' END AS ratio,
CASE WHEN p_partkey % 4 = 0 AND p_size % 3 <> 0 THEN '击穿' WHEN p_partkey % 4 = 1 AND p_size % 3 <> 0 THEN '未击穿' END AS contradiction FROM part""")
def row_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.when(part_key() % 5 == 0, F.array(part_size().cast("double"))).otherwise(F.array(part_size().cast("double"), F.lit(50.0)))
    result = F.when(part_key() % 4 == 0, "未击穿、击穿").when(part_key() % 4 == 1, "未发生击穿").when(part_key() % 4 == 2, "不击穿").otherwise("击穿 3 次")
    verdict = F.when(part_key() % 2 == 0, "p").otherwise("N")
    return parts(spark, sf_dir).select("p_partkey", context.ratio_pair(values, F.when(part_key() % 2 == 0, "P").otherwise("F")).alias("ratio"), context.verdict_contradiction(result, F.when(part_key() % 4 == 3, "N").otherwise(verdict), part_size() % 3 == 0).alias("contradiction"))


@registered("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN 'manual_review' ELSE 'fail' END AS verdict, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN 'fail' END AS prior_verdict FROM part""")
def retracted_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(part_key() % 3 == 0, "老化试验不适用；P应改判N").when(part_key() % 3 == 1, "老化试验不适用，数值也超限").otherwise("")
    checks = parts(spark, sf_dir).select("p_partkey", "p_size", note.alias("note"), F.lit("fail").alias("verdict"))
    required = parts(spark, sf_dir).filter("p_size % 2 = 0").select("p_size")
    return context.retracted_exclusions(checks, required, ["p_size"], "^(?:.*不适用|P应改判N)$").select("p_partkey", "verdict", "prior_verdict")


@registered("""SELECT o_orderkey, '应提供第' || k || '项的检验结果' AS should_be, 'GB 表' || k AS standard FROM orders CROSS JOIN (VALUES (1), (2), (3)) AS v(k) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = k)""")
def missing_required_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsheaf.operators import verdicts

    wanted = orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("l_linenumber"))
    covered = verdicts.coverage(wanted, lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], F.lit(True))
    named = covered.withColumn("item", said("第", F.col("l_linenumber"), "项"))
    return context.missing_required(named, "item", said("GB 表", F.col("l_linenumber"))).select(F.col("l_orderkey").alias("o_orderkey"), "should_be", "standard")


@registered("""SELECT o_orderkey, c.c_name AS reporter, s.s_name AS reviewer, o_totalprice FROM orders LEFT JOIN customer AS c ON c.c_custkey = o_custkey LEFT JOIN supplier AS s ON s.s_suppkey = o_orderkey % 200""")
def corrections_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(said("c", F.col("c_custkey")).alias("user_id"), F.col("c_name").alias("name")).unionByName(table(spark, sf_dir, "supplier").select(said("s", F.col("s_suppkey")).alias("user_id"), F.col("s_name").alias("name")))
    corrections = orders(spark, sf_dir).select(F.col("o_orderkey").alias("report_id"), said("c", F.col("o_custkey")).alias("reporter_id"), said("s", F.col("o_orderkey") % 200).alias("reviewer_id"))
    reports = orders(spark, sf_dir).select(F.col("o_orderkey").alias("report_id"), "o_totalprice")
    return context.audit_listing(corrections, people, reports).select(F.col("report_id").alias("o_orderkey"), "reporter", "reviewer", "o_totalprice")


@registered(f"""SELECT l_orderkey, coalesce(string_agg('第' || l_linenumber || '项：' || l_partkey, '；' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag <> 'A'), '') AS evidence,
coalesce(string_agg('第' || l_linenumber || '项：' || l_partkey, '；' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag = 'A'), '') AS pending FROM lineitem GROUP BY 1""")
def readable_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = lines(spark, sf_dir).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), said("第", F.col("l_linenumber"), "项").alias("item"), F.col("l_partkey").cast("string").alias("reported"), F.when(F.col("l_returnflag") == "A", "manual_review").otherwise("pass").alias("verdict"))
    return context.readable_checks(checks, "l_orderkey", "pos")


@registered("""SELECT p_brand, sum(p_size)::BIGINT AS total, sum(p_partkey % 40)::BIGINT AS filed, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS brands, bool_or(p_size = 1) OR sum(p_partkey % 40) > sum(p_size) AS needs_review,
min(least(p_size, CASE WHEN p_size % 2 = 0 THEN p_size / 2 END))::DOUBLE AS least, max(greatest(p_size, CASE WHEN p_size % 2 = 0 THEN p_size + 3 END))::DOUBLE AS most, bool_and(p_size <> 7) AS exact_only FROM part GROUP BY 1""")
def supplier_groups_and_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("p_brand", part_size().alias("total"), (part_key() % 40).alias("filed"), F.array("p_type").alias("brands"), (part_size() == 1).alias("needs_review"))
    groups = context.supplier_groups(rows, ["p_brand"]).withColumn("brands", F.array_join("brands", ",")).withColumn("total", F.col("total").cast("long"))
    size = part_size().cast("double")
    domain = parts(spark, sf_dir).select("p_brand", F.when(part_size() != 7, F.array(size)).alias("values"), F.when(part_size() % 2 == 0, size / 2).when(part_size() == 7, size).alias("low"), F.when(part_size() % 2 == 0, size + 3).when(part_size() == 7, size).alias("high"))
    return groups.join(context.value_domain(domain, ["p_brand"], "values", "low", "high"), "p_brand")

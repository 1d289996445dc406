"""Queries over parts and line items (product models and checks), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.functions import normalize as N
from docsheaf.functions import specs
from docsheaf.operators import conditions, matching, reconcile, rulepack, sampling, summaries, verdicts, versions
from docsheaf.plans.tables import table

SQL: dict[str, str] = {}
TREE = {
    "op": "any",
    "rules": [
        {"op": "all", "rules": [{"op": ">=", "field": "p_size", "value": 10}, {"op": "in", "field": "p_type", "value": ["SMALL", "PROMO"]}]},
        {"op": "not", "rule": {"op": "between", "field": "price", "min": 950, "max": 1050}},
        {"op": "all", "rules": []},
    ],
}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("price", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")))


def condition_tree_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return conditions.state_histogram(parts, conditions.compile_condition(TREE, parts.schema))


SQL["condition_tree_eval"] = """SELECT coalesce(((p_size >= 10 AND p_type IN ('SMALL', 'PROMO')) OR NOT (price BETWEEN 950 AND 1050) OR NULL)::VARCHAR, 'unknown') AS state, count(*) AS n
FROM (SELECT *, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price FROM part) GROUP BY 1"""


def latest_rule_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.newest(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_size").desc(), F.col("p_partkey").desc()]).select("p_brand", "p_partkey", "p_size")


SQL["latest_rule_version"] = "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) = 1"


def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two sources say of a part: its line items' status, and its own size class."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.concat(F.lit("status of line "), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_linestatus").alias("value"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.lit("status of line 1").alias("field"), F.when(F.col("p_size") > 25, "F").when(F.col("p_size") > 2, "O").alias("value"))
    return conditions.reconcile_facts(lines.unionByName(parts), "part")


SQL["fact_conflicts"] = """SELECT part, field, CASE WHEN count(DISTINCT value) = 1 AND count(*) FILTER (value IS NULL) = 0 THEN min(value) END AS value, NOT (count(DISTINCT value) = 1 AND count(*) FILTER (value IS NULL) = 0) AS conflict
FROM (SELECT l_partkey AS part, concat('status of line ', l_linenumber) AS field, l_linestatus AS value FROM lineitem UNION ALL SELECT p_partkey, 'status of line 1', CASE WHEN p_size > 25 THEN 'F' WHEN p_size > 2 THEN 'O' END FROM part) GROUP BY 1, 2"""

_SQL_VERDICT = "CASE l_returnflag WHEN 'N' THEN 'pass' WHEN 'R' THEN 'fail' ELSE 'manual_review' END"


def _verdict():
    return F.when(F.col("l_returnflag") == "N", "pass").when(F.col("l_returnflag") == "R", "fail").otherwise("manual_review")


def numeric_range_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("verdict", _verdict())
    upper = F.when(F.col("l_linenumber") != 7, F.lit("0.08"))
    state = verdicts.range_state(F.col("l_discount"), F.lit("0.02"), upper, F.lit(False), F.lit(True))
    return lines.groupBy("l_returnflag", state.alias("state"), verdicts.guarded_verdict(state, F.col("verdict")).alias("verdict")).agg(F.count("*").alias("n"))


SQL["numeric_range_rule"] = f"""WITH s AS (SELECT l_returnflag, {_SQL_VERDICT} AS v, CASE WHEN l_linenumber = 7 THEN 'unknown' WHEN l_discount::DECIMAL(18, 6) <= 0.02 OR l_discount::DECIMAL(18, 6) > 0.08 THEN 'exceeds' ELSE 'within' END AS state FROM lineitem)
SELECT l_returnflag, state, CASE WHEN v = 'pass' AND state = 'exceeds' THEN 'fail' WHEN v = 'pass' AND state = 'unknown' THEN 'manual_review' ELSE v END AS verdict, count(*) AS n FROM s GROUP BY 1, 2, 3"""


def required_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order requires lines 1 to 3; line 4 if it is large, where small and middle prices decide and others don't."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_totalprice", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("l_linenumber"))
    condition = F.when(F.col("l_linenumber") < 4, True).when(F.col("o_totalprice") > 400_000, F.lit(None)).otherwise(F.col("o_totalprice") > 200_000)
    covered = verdicts.coverage(orders, table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], condition)
    return verdicts.coverage_counts(covered, ["o_orderpriority"])


SQL["required_coverage"] = """WITH r AS (SELECT o_orderkey, o_orderpriority, k, CASE WHEN k < 4 THEN true WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice > 200000 END AS c FROM orders, (VALUES (1), (2), (3), (4)) AS v(k)),
o AS (SELECT o_orderpriority, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = k) THEN 'covered' WHEN c IS NULL THEN 'unknown' WHEN NOT c THEN 'not_applicable' ELSE 'missing' END AS outcome FROM r)
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (outcome = 'covered') AS covered, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'not_applicable') AS not_applicable, count(*) FILTER (outcome = 'unknown') AS unknown FROM o GROUP BY 1"""


def change_rate_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose reported change (taken from the line number) is not that from quantity to discounted quantity."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    calculated = verdicts.change_rates(F.array("l_quantity", "l_extendedprice"), F.array(F.col("l_quantity") * (1 - F.col("l_discount")), F.col("l_extendedprice") * (1 + F.col("l_tax"))))
    reported = F.array(-F.col("l_linenumber").cast("double"), F.col("l_linenumber").cast("double"))
    wrong = verdicts.mismatched_columns(calculated, reported)
    return l.groupBy("l_linenumber", F.array_join(wrong.cast("array<string>"), ",").alias("wrong")).agg(F.count("*").alias("n"))


SQL["change_rate_recompute"] = """WITH c AS (SELECT l_linenumber, coalesce(CASE WHEN l_quantity > 0 THEN round((l_quantity * (1 - l_discount) / l_quantity - 1) * 100) END <> -l_linenumber, false) AS a,
 coalesce(CASE WHEN l_extendedprice > 0 THEN round((l_extendedprice * (1 + l_tax) / l_extendedprice - 1) * 100) END <> l_linenumber, false) AS b FROM lineitem)
SELECT l_linenumber, concat_ws(',', CASE WHEN a THEN '1' END, CASE WHEN b THEN '2' END) AS wrong, count(*) AS n FROM c GROUP BY 1, 2"""


def step_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.step_lookup(table(spark, sf_dir, "part"), "p_size", [(6, 100.0), (10, 200.0), (15, 300.0), (25, 400.0)], 600.0, "mass")
    return rows.groupBy("mass").agg(F.count("*").alias("n"), F.min("p_size").cast("long").alias("smallest"))


SQL["step_table_lookup"] = "SELECT CASE WHEN p_size <= 6 THEN 100.0 WHEN p_size <= 10 THEN 200.0 WHEN p_size <= 15 THEN 300.0 WHEN p_size <= 25 THEN 400.0 ELSE 600.0 END::DOUBLE AS mass, count(*) AS n, min(p_size)::BIGINT AS smallest FROM part GROUP BY 1"


def param_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules: per brand the sizes it allows, open above for brands whose largest part is large."""
    parts = table(spark, sf_dir, "part")
    rules = parts.groupBy(F.col("p_brand").alias("rule_brand")).agg((F.min("p_size") + 5).alias("size_min"), F.max("p_size").alias("m"), F.min("p_retailprice").alias("price_min")).withColumn("size_max", F.when(F.col("m") < 50, F.col("m") - 5)).withColumn("price_max", F.col("price_min") + 100)
    hits = matching.range_join(parts, rules, F.col("p_brand") == F.col("rule_brand"), [("p_size", "size_min", "size_max"), ("p_retailprice", "price_min", "price_max")])
    return hits.select("p_partkey", "p_brand", "size_min", "size_max")


SQL["param_range_join"] = """WITH r AS (SELECT p_brand AS rule_brand, min(p_size) + 5 AS size_min, CASE WHEN max(p_size) < 50 THEN max(p_size) - 5 END AS size_max, min(p_retailprice) AS price_min FROM part GROUP BY 1)
SELECT p_partkey, p_brand, size_min, size_max FROM part JOIN r ON p_brand = rule_brand WHERE p_size >= size_min AND coalesce(p_size <= size_max, true) AND p_retailprice >= price_min AND p_retailprice <= price_min + 100"""


def unique_or_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every other number look one size up, so some find no part, some one, some several."""
    parts = table(spark, sf_dir, "part")
    master = parts.select(F.col("p_partkey").alias("match"), "p_brand", "p_size", "p_type")
    rows = parts.select("p_partkey", "p_brand", (F.col("p_size") + F.col("p_partkey") % 2).cast("int").alias("p_size"), "p_type")
    return matching.unique_or_unresolved(rows, master, ["p_brand", "p_size", "p_type"], ["match"]).select("p_partkey", "candidates", "match")


SQL["unique_or_unresolved"] = """WITH m AS (SELECT p_brand, p_size, p_type, count(*) AS c, min(p_partkey) AS k FROM part GROUP BY 1, 2, 3)
SELECT r.p_partkey, coalesce(c, 0) AS candidates, CASE WHEN c = 1 THEN k END AS match FROM part AS r LEFT JOIN m ON m.p_brand = r.p_brand AND m.p_type = r.p_type AND m.p_size = r.p_size + r.p_partkey % 2"""


def alias_fallback_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every third number have lost their type, and are found by the rest of the key."""
    parts = table(spark, sf_dir, "part")
    master = parts.select("p_brand", "p_size", "p_type", F.col("p_partkey").alias("match"))
    rows = parts.select("p_partkey", "p_brand", "p_size", F.when(F.col("p_partkey") % 3 == 0, "?").otherwise(F.col("p_type")).alias("p_type"))
    return matching.with_fallback(rows, "p_partkey", master, ["p_brand", "p_size", "p_type"], ["p_brand", "p_size"], "match").select("p_partkey", "match", "bound_by")


SQL["alias_fallback_binding"] = """WITH e AS (SELECT p_brand, p_size, p_type, count(*) AS c, min(p_partkey) AS k FROM part GROUP BY 1, 2, 3), a AS (SELECT p_brand, p_size, count(*) AS c, min(p_partkey) AS k FROM part GROUP BY 1, 2),
r AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 3 = 0 THEN '?' ELSE p_type END AS p_type FROM part)
SELECT p_partkey, CASE WHEN e.c = 1 THEN e.k WHEN e.c IS NULL AND a.c = 1 THEN a.k END AS match, CASE WHEN e.c = 1 THEN 'exact' WHEN e.c IS NULL AND a.c = 1 THEN 'alias' END AS bound_by
FROM r LEFT JOIN e USING (p_brand, p_size, p_type) LEFT JOIN a USING (p_brand, p_size)"""


def verdict_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", _verdict().alias("verdict"), "l_quantity", "l_linenumber", F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey").alias("pos"))
    out = verdicts.consensus(lines, ["l_partkey", "l_linestatus"], "verdict", F.col("l_quantity") > 44, "pos", "l_linenumber")
    return out.withColumn("segments", F.array_join(F.col("segments").cast("array<string>"), ","))


SQL["verdict_consensus"] = f"""WITH c AS (SELECT l_partkey, l_linestatus, {_SQL_VERDICT} AS v, l_quantity > 44 AS e, l_linenumber, l_orderkey, l_returnflag, l_suppkey, bool_or(l_quantity > 44) OVER (PARTITION BY l_partkey, l_linestatus) AS has FROM lineitem),
k AS (SELECT * FROM c WHERE e OR NOT has)
SELECT l_partkey, l_linestatus, CASE WHEN bool_or(v = 'pass') AND bool_or(v = 'fail') THEN 'manual_review' ELSE first(v ORDER BY l_orderkey, l_linenumber, l_returnflag, l_suppkey) END AS verdict,
 bool_or(v = 'pass') AND bool_or(v = 'fail') AS conflict, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS segments FROM k GROUP BY 1, 2"""


def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey")
    out = verdicts.first_wins(lines, ["l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_suppkey"], "l_linenumber")
    return out.withColumn("segments", F.array_join(F.col("segments").cast("array<string>"), ","))


SQL["first_wins_dedupe"] = """SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, l_suppkey, array_to_string(s, ',') AS segments FROM
(SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1)
JOIN (SELECT l_partkey, l_returnflag, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem GROUP BY 1, 2) USING (l_partkey, l_returnflag)"""


def missing_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    kept = verdicts.missing_suppressed(lines, lines, ["l_partkey", "l_suppkey"], F.col("l_returnflag") == "R", (F.col("l_returnflag") == "N") & (F.col("l_quantity") > 25))
    return kept.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))


SQL["missing_suppressed"] = """SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem AS f WHERE l_returnflag <> 'R' OR NOT EXISTS
(SELECT 1 FROM lineitem AS c WHERE c.l_partkey = f.l_partkey AND c.l_suppkey = f.l_suppkey AND c.l_returnflag = 'N' AND c.l_quantity > 25) GROUP BY 1, 2"""


def budget_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    kept = verdicts.budget(lines, ["l_orderkey"], "pos", F.col("l_returnflag") == "N", 2)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("passes"), F.sum("l_linenumber").alias("lines"))


SQL["budget_topk"] = """WITH w AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c, greatest(2 - count(*) FILTER (l_returnflag <> 'N') OVER (PARTITION BY l_orderkey), 0) AS room,
 count(*) FILTER (l_returnflag = 'N') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS taken FROM lineitem)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS passes, sum(l_linenumber)::BIGINT AS lines FROM w WHERE l_returnflag <> 'N' OR c <= 2 OR taken <= room GROUP BY 1"""


def field_verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.roll_up(table(spark, sf_dir, "lineitem").withColumn("verdict", _verdict()), ["l_orderkey"], "verdict")


SQL["field_verdict_rollup"] = f"SELECT l_orderkey, CASE WHEN bool_or(v = 'fail') THEN 'fail' WHEN bool_or(v NOT IN ('pass', 'fail')) THEN 'manual_review' ELSE 'pass' END AS verdict, count(*) AS fields FROM (SELECT l_orderkey, {_SQL_VERDICT} AS v FROM lineitem) GROUP BY 1"


def action_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", _verdict().alias("verdict"))
    findings = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_discount") > 0.05).alias("action_required"))
    out = verdicts.consistent_actions(checks, findings, ["l_orderkey", "l_suppkey"])
    return out.groupBy("verdict", "prior_verdict").agg(F.count("*").alias("n"))


SQL["action_consistency"] = f"""WITH c AS (SELECT {_SQL_VERDICT} AS v, EXISTS (SELECT 1 FROM lineitem AS f WHERE f.l_orderkey = l.l_orderkey AND f.l_suppkey = l.l_suppkey AND f.l_discount > 0.05) AS o FROM lineitem AS l),
d AS (SELECT v, (v = 'pass' AND o) OR (v = 'fail' AND NOT o) AS odd FROM c)
SELECT CASE WHEN odd THEN 'manual_review' ELSE v END AS verdict, CASE WHEN odd THEN v END AS prior_verdict, count(*) AS n FROM d GROUP BY 1, 2"""


def rule_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        rulepack.PackRule("small", 1, "l_quantity < 5", "suppress", condition={"op": "==", "field": "l_returnflag", "value": "N"}),
        rulepack.PackRule("discount", 1, "l_discount > 0.08", "set_verdict", "fail", {"op": ">", "field": "l_tax", "value": 0.02}, "manual_review"),
        rulepack.PackRule("late", 2, "verdict = 'fail'", "add_finding", "check shipping", {"op": ">=", "field": "l_linenumber", "value": 4}),
        rulepack.PackRule("note", 2, "verdict = 'pass'", "annotate", "ok"),
    ]
    lines = table(spark, sf_dir, "lineitem").withColumn("verdict", _verdict())
    checks, findings = rulepack.apply_rule_pack(lines, rules)
    a = checks.groupBy("verdict", F.array_join("applied", ",").alias("applied")).agg(F.count("*").alias("n"))
    b = findings.groupBy("verdict", F.col("finding").alias("applied")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


SQL["rule_pack"] = f"""WITH a AS (SELECT *, {_SQL_VERDICT} AS v, l_quantity < 5 AND l_returnflag = 'N' AS gone FROM lineitem),
b AS (SELECT *, NOT gone AND l_discount > 0.08 AND l_tax > 0.02 AS d FROM a), c AS (SELECT *, CASE WHEN d THEN 'fail' ELSE v END AS v2 FROM b),
e AS (SELECT *, NOT gone AND v2 = 'fail' AND l_linenumber >= 4 AS late, NOT gone AND v2 = 'pass' AS note FROM c)
SELECT v2 AS verdict, concat_ws(',', CASE WHEN d THEN 'discount' END, CASE WHEN late THEN 'late' END, CASE WHEN note THEN 'note' END) AS applied, count(*) AS n FROM e WHERE NOT gone GROUP BY 1, 2
UNION ALL SELECT v2, 'check shipping', count(*) FROM e WHERE late GROUP BY 1"""


def label_4gram_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    ids = labels.withColumn("id", F.xxhash64("p_brand", "p_name")).select("p_brand", "id", "p_name")
    pairs = matching.label_matches(ids, ["p_brand"], "id", "p_name")
    names = ids.select(F.col("id").alias("i"), F.col("p_name").alias("n"))
    both = pairs.join(names.select(F.col("i").alias("a"), F.col("n").alias("x")), "a").join(names.select(F.col("i").alias("b"), F.col("n").alias("y")), "b")
    return both.select("p_brand", F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"))


SQL["label_4gram_match"] = """WITH l AS (SELECT DISTINCT p_brand, p_name FROM part), g AS (SELECT DISTINCT p_brand, p_name, substring(p_name, i, 4) AS gram FROM (SELECT p_brand, p_name, unnest(range(1, length(p_name) - 2)) AS i FROM l))
SELECT DISTINCT a.p_brand, a.p_name AS first, b.p_name AS second FROM g AS a JOIN g AS b ON a.p_brand = b.p_brand AND a.gram = b.gram AND a.p_name < b.p_name"""


def spec_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications made of each part's numbers: groups, brackets and malformed ones."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    spec = F.when(key % 4 == 0, F.concat(size, F.lit(" x 2.50 mm2"))).when(key % 4 == 1, F.concat(F.lit("2×("), size, F.lit("×0.75)+1×0.75"))).when(key % 4 == 2, F.concat(size, F.lit("×1.5+1×"), size)).otherwise(F.concat(size, F.lit("×(1.5")))
    return specs.with_spec_facts(table(spark, sf_dir, "part").select("p_partkey", spec.alias("spec"))).select("p_partkey", F.col("core_count").cast("long").alias("core_count"), "section", "canonical_spec")


SQL["spec_facts"] = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 2 * p_size + 1 WHEN 2 THEN p_size + 1 END::BIGINT AS core_count, CASE p_partkey % 4 WHEN 0 THEN 2.5 WHEN 1 THEN 0.75 END::DOUBLE AS section,
CASE p_partkey % 4 WHEN 0 THEN p_size || '×2.5mm²' WHEN 1 THEN '2×(' || p_size || '×0.75)+1×0.75mm²' WHEN 2 THEN p_size || '×1.5+1×' || p_size || 'mm²' END AS canonical_spec FROM part"""


def model_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", "p_size", F.array("p_type").alias("types"), (F.col("p_retailprice") > 1090).alias("flag"))
    return summaries.envelope(parts, ["p_brand"], "p_size", "p_size", "types", "flag").withColumn("values", F.array_join("values", ","))


SQL["model_envelope"] = "SELECT p_brand, min(p_size) AS low, max(p_size) AS high, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS values, bool_or(p_retailprice > 1090) AS flag FROM part GROUP BY 1"


def display_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines report a tax, in whole per cent, that displayed prices before and after allow."""
    price = F.col("l_extendedprice")
    ok = N.display_change_overlap(F.format_string("%.1f", price), F.format_string("%.1f", price * (1 + F.col("l_tax"))), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count_if(ok).alias("possible"), F.count("*").alias("n"))


SQL["display_intervals"] = """WITH d AS (SELECT l_linenumber, round(l_extendedprice::DECIMAL(18, 2), 1)::DOUBLE AS b, round((l_extendedprice * (1 + l_tax))::DECIMAL(18, 6), 1)::DOUBLE AS a FROM lineitem)
SELECT l_linenumber, count(*) FILTER (b - 0.05 > 0 AND ((a - 0.05) / (b + 0.05) - 1) * 100 <= l_linenumber + 0.5 AND ((a + 0.05) / (b - 0.05) - 1) * 100 >= l_linenumber - 0.5) AS possible, count(*) AS n FROM d GROUP BY 1"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("double")).alias("sizes"), F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("hi"), F.collect_set(F.when(F.col("p_type").isin("SMALL", "LARGE"), F.col("p_type"))).alias("shapes"))
    listed = F.when(F.col("p_brand") < "Brand#2", F.col("sizes"))
    groups = groups.withColumn("sections", sampling.bounded(listed, F.col("lo"), F.col("hi"), F.lit(4.0), F.lit(16.0))).withColumn("cores", F.array(F.lit(2), F.lit(3), F.lit(5)))
    return sampling.candidates(groups, ["p_brand"], "sections", "cores", "shapes").filter("section is not null")


_CAND = """c AS (SELECT DISTINCT p_brand, section, cores, shape FROM (
  SELECT DISTINCT p_brand, p_size::DOUBLE AS section FROM part WHERE p_brand < 'Brand#2' AND p_size BETWEEN 4 AND 16
  UNION SELECT p_brand, greatest(min(p_size), 4)::DOUBLE FROM part WHERE p_brand >= 'Brand#2' GROUP BY 1 HAVING greatest(min(p_size), 4) <= least(max(p_size), 16)
  UNION SELECT p_brand, least(max(p_size), 16)::DOUBLE FROM part WHERE p_brand >= 'Brand#2' GROUP BY 1 HAVING greatest(min(p_size), 4) <= least(max(p_size), 16)) AS s
  JOIN (VALUES (2), (3), (5)) AS k(cores) ON true LEFT JOIN (SELECT DISTINCT p_brand, p_type AS shape FROM part WHERE p_type IN ('SMALL', 'LARGE')) USING (p_brand))"""


def candidate_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


SQL["candidate_expansion"] = f"WITH {_CAND} SELECT * FROM c"


def coverage_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.coverage_tasks(_candidates(spark, sf_dir), ["p_brand"])


_TASKS = """t AS (SELECT p_brand, 'min_section' AS kind, min(section) AS section, NULL::INT AS cores, NULL AS shape FROM c GROUP BY 1 UNION ALL SELECT p_brand, 'max_section', max(section), NULL, NULL FROM c GROUP BY 1
UNION ALL SELECT p_brand, 'max_cores_min_section', min(section), 5, NULL FROM c GROUP BY 1 UNION ALL SELECT p_brand, 'min_cores_max_section', max(section), 2, NULL FROM c GROUP BY 1
UNION ALL SELECT DISTINCT p_brand, 'shape', NULL, NULL, shape FROM c WHERE shape IS NOT NULL)"""
SQL["coverage_tasks"] = f"WITH {_CAND}, {_TASKS} SELECT * FROM t"


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cands = _candidates(spark, sf_dir).select("p_brand", F.col("section").alias("c_section"), F.col("cores").alias("c_cores"), F.col("shape").alias("c_shape"))
    cands = cands.withColumn("candidate", F.xxhash64("p_brand", "c_section", "c_cores", "c_shape")).withColumn("cost", F.col("c_section") * F.col("c_cores"))
    tasks = sampling.coverage_tasks(_candidates(spark, sf_dir), ["p_brand"]).withColumn("task", F.concat_ws(":", "kind", "shape"))
    sequence = sampling.ranked_sequence(table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("section")), ["p_brand"], "section")
    return sampling.matches(tasks, cands, ["p_brand"], sequence), tasks


def task_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, tasks = _pairs(spark, sf_dir)
    per = pairs.groupBy("p_brand", "task").agg(F.count_distinct("candidate").alias("candidates"))
    none = sampling.infeasible(pairs, tasks, ["p_brand"]).select("p_brand", "task", F.lit(0).cast("long").alias("candidates"))
    return per.unionByName(none)


SQL["task_feasibility"] = f"""WITH {_CAND}, {_TASKS}, q AS (SELECT p_brand, section, row_number() OVER (PARTITION BY p_brand ORDER BY section) AS r FROM (SELECT DISTINCT p_brand, p_size::DOUBLE AS section FROM part))
SELECT t.p_brand, concat_ws(':', t.kind, t.shape) AS task, count(c.p_brand) FILTER ((t.section IS NULL OR CASE WHEN c.section > 10 OR t.section > 10 THEN c.section = t.section ELSE c.section = t.section OR coalesce(abs(qc.r - qt.r) = 1, false) END)
 AND (t.cores IS NULL OR c.cores = t.cores) AND (t.shape IS NULL OR c.shape = t.shape)) AS candidates
FROM t JOIN c ON c.p_brand = t.p_brand LEFT JOIN q AS qc ON qc.p_brand = c.p_brand AND qc.section = c.section LEFT JOIN q AS qt ON qt.p_brand = t.p_brand AND qt.section = t.section GROUP BY 1, 2"""


def set_cover_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, tasks = _pairs(spark, sf_dir)
    plan = sampling.set_cover(pairs, tasks, "p_brand")
    return sampling.assigned(pairs, plan, "p_brand").select("p_brand", "task", "candidate", "cost")


def material_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand and size, parts as demands; each may use the sample of its own type, or that of the next size."""
    parts = table(spark, sf_dir, "part")
    demand = parts.select(F.concat_ws("/", "p_brand", F.floor(F.col("p_size") / 5).cast("string")).alias("plan"), F.col("p_partkey").cast("string").alias("demand"), "p_size", "p_type")
    own, next_one = (F.concat_ws("/", (F.col("p_size") + k).cast("string"), "p_type") for k in (0, 1))
    return sampling.allocate(demand.select("plan", "demand", F.explode(F.array(own, next_one)).alias("slot")), "plan")


def segment_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as checks of their order: the part's name is the item, so containment groups them."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item")), "l_partkey")
    checks = lines.select("l_orderkey", "item", _verdict().alias("verdict"), F.col("l_quantity").cast("string").alias("reported"), (F.col("l_quantity") > 20).alias("evidenced"), F.col("l_linenumber").alias("segment"), "l_partkey", "l_suppkey")
    return reconcile.segment_consensus(checks, ["l_orderkey"], ["segment", "l_partkey", "l_suppkey"])


def report_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item")), "l_partkey")
    pos = F.col("l_linenumber") * 100_000 + F.col("l_partkey")
    checks = lines.filter("l_linenumber <= 4").select("l_orderkey", pos.alias("pos"), "item", _verdict().alias("verdict"))
    findings = lines.filter("l_linenumber > 4").select("l_orderkey", pos.alias("pos"), "item", F.when(F.col("l_discount") > 0.05, "must_fix").otherwise("suggestion").alias("severity"), (F.col("l_tax") > 0).alias("action_required"))
    return reconcile.conclusions(checks, findings, "l_orderkey")


QUERIES = {
    f.__name__: f
    for f in (condition_tree_eval, latest_rule_version, fact_conflicts, numeric_range_rule, required_coverage, change_rate_recompute, step_table_lookup, param_range_join, unique_or_unresolved, alias_fallback_binding, verdict_consensus, first_wins_dedupe, missing_suppressed, budget_topk, field_verdict_rollup, action_consistency, rule_pack, label_4gram_match, spec_facts, model_envelope, display_intervals, candidate_expansion, coverage_tasks, task_feasibility, set_cover_plan, material_matching, segment_consensus, report_conclusions)
}

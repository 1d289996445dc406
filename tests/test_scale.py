"""What keeps the work of a query in proportion to its tables: plans and bounds, beside the results."""

import duckdb

import __spark_entry__
from docsheaf.llm import exact
from docsheaf.operators import context, matching, observations, packs, rulepack
from docsheaf.plans.tables import dealt


def plan(df):
    return df._jdf.queryExecution().toString()


def test_lines_are_not_sent_to_the_driver(spark, sf_dir):
    assert "BuildLeft" not in plan(__spark_entry__.queries()["consecutive_lines"](spark, sf_dir))


def test_chosen_models_of_a_name_that_many_models_share(spark):
    texts = spark.createDataFrame([(1, "ab c"), (1, "ab"), (2, "AB"), (2, "z"), (None, "ab")], "k int, token string")
    models = spark.createDataFrame([(i, "AB" if i % 2 else "AB C", ["Z", "AB"] if i == 40 else None) for i in range(100)], "model_id int, code string, aliases array<string>")
    got = context.chosen_models(texts, models, "k", 90, 3)
    assert sorted((r["k"], r["model_id"], r["score"], r["rank"]) for r in got.collect()) == [(1, 0, 130, 1), (1, 2, 130, 2), (1, 4, 130, 3), (2, 1, 100, 1), (2, 3, 100, 2), (2, 5, 100, 3)]
    assert "WindowGroupLimit [name" in plan(got)


def test_rule_parameters_join_only_the_first_of_a_method(spark):
    chosen = spark.createDataFrame([(1, 10, "a"), (1, 11, None), (2, 12, None), (3, 10, "a"), (3, 11, None), (4, 10, "b")], "k int, model_id int, series_id string")
    matrix = spark.createDataFrame([(m, 1, 5, "required", "verified") for m in (10, 11, 12)] + [(10, None, 6, "not_applicable", "verified"), (11, 3, 6, "required", "open")], "model_id int, test_method_id int, test_item_id int, applicability_status string, verification_status string")
    methods = spark.createDataFrame([(2, 5), (2, 5), (3, 6)], "id int, test_item_id int")
    rules = [(i, 1 + i % 3, f"p{i % 40}", "=", "", "mm", i % 7, None, None) for i in range(300)]
    rules += [(900, 1, "p0", "=", "", "mm", 9, 12, None), (901, 2, "own", "=", "", None, 9, 10, "b"), (902, 2, "own", "=", "", None, 8, 11, "a"), (903, 1, "s", "=", "", "", 10, None, "a"), (904, 2, "s", "=", "", "", 10, None, "b")]
    names = ["id", "test_method_id", "parameter_name", "operator", "parameter_value", "unit", "priority", "model_id", "series_id"]
    parameters = spark.createDataFrame(rules, "id int, test_method_id int, parameter_name string, operator string, parameter_value string, unit string, priority int, model_id int, series_id string")

    def plain(key, most):
        models = {m for k, m, _ in chosen.collect() if k == key}
        series = {s for k, _, s in chosen.collect() if k == key and s}
        best = {}
        for r in sorted((dict(zip(names, r, strict=True)) for r in rules), key=lambda r: (-r["priority"], r["id"])):
            if r["test_method_id"] in (1, 2) and r["model_id"] in (None, *models) and (r["series_id"] is None or not series or r["series_id"] in series):
                best.setdefault((r["test_method_id"], r["parameter_name"]), r["id"])
        order = {r[0]: (-r[6], r[0]) for r in rules}
        return sorted(best.values(), key=order.get)[:most]

    for most in (3, 200):
        got = context.rule_parameters(chosen, matrix, methods, parameters, "k", most)
        found = sorted((r["k"], r["rank"], r["id"]) for r in got.collect())
        assert [[r[2] for r in found if r[0] == key] for key in (1, 2, 3, 4)] == [plain(key, most) for key in (1, 2, 3, 4)]
    assert "WindowGroupLimit [asks" in plan(got)
    keys, choices = context.shared_models(chosen, "k")
    assert keys.count() == 4 and choices.select("choice").distinct().count() == 3


def test_rows_are_dealt_by_their_number(spark):
    assert dealt(spark.range(60_000), "id").rdd.getNumPartitions() == 3
    few = spark.range(25_000)
    assert dealt(few, "id") is few


def test_tables_of_a_row_each_are_merged(spark, sf_dir):
    for name in ("reference_gates", "table_grid", "box_observations"):
        assert "BroadcastHashJoin" not in plan(__spark_entry__.queries()[name](spark, sf_dir)), name


def test_boxes_of_parts_that_are_dealt(spark, tmp_path):
    parts = str(tmp_path / "part.parquet")
    spark.range(60_000).selectExpr("id p_partkey", "cast(1 + id % 50 as int) p_size").coalesce(1).write.parquet(parts)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{parts}/*.parquet'")
    got = __spark_entry__.queries()["coordinate_observations"](spark, str(tmp_path))
    sql = con.sql(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()['coordinate_observations']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, sql))


def test_boxes_of_a_union_of_dealt_tables(spark, tmp_path):
    spark.range(300).selectExpr("id k").write.parquet(str(tmp_path / "t"))

    def boxes(when, *page):
        rows = ", ".join(f"struct('{t}' as text, {x}D as left, {x + 10}D as right, {y}D as top)" for t, x, y in page)
        return dealt(spark.read.parquet(str(tmp_path / "t")), "k", rows=100).selectExpr("k", f"explode(array({rows})) b").filter(when).select("k", "b.*")

    pages = boxes("true", ("项 目", 0, 0), ("结果", 50, 1), ("厚度", 2, 20), ("5", 48, 22)).unionByName(boxes("k % 3 = 1", ("7", 40, 22))).unionByName(boxes("k % 3 = 2", ("结果", 80, 0)))
    expected = sorted((k, *[("1", "厚度", "5", "None"), ("1", "厚度", "5", "several_values"), ("None", "None", "None", "header_not_unique")][k % 3]) for k in range(300))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("-1", kept):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = observations.coordinate_rows(pages, ["k"], {"item": ["项目"], "result": ["结果"]})
            assert sorted((r["k"], *[str(r[c]) for c in ("row", "item", "result", "reason")]) for r in got.collect()) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "Join" not in plan(got)


def test_box_matches_of_parts_that_are_dealt_and_merged(spark, tmp_path):
    parts = str(tmp_path / "part.parquet")
    spark.range(60_000).selectExpr("id p_partkey", "cast(1 + id % 50 as int) p_size", "concat('t', id % 7) p_type").coalesce(1).write.parquet(parts)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{parts}/*.parquet'")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = __spark_entry__.queries()["box_matches"](spark, str(tmp_path))
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    sql = con.sql(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()['box_matches']})").fetchall()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, sql))


def test_groups_stream_and_supplements_join_once(spark, sf_dir):
    for name in ("page_text_lines", "column_witnesses"):
        assert "FlatMapGroupsInPandas" not in plan(__spark_entry__.queries()[name](spark, sf_dir)), name
    pages = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "x"), (2, 1, "c", "x"), (None, 1, "d", "x")], "doc int, page int, text string, i string")
    more = spark.createDataFrame([(1, 1, "A", "x"), (2, 1, "C", "x")], "doc int, page int, text string, i string")
    got = matching.supplemented(pages, more, "doc", "page", "i")
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a\nA", True), (1, 2, "b", True), (2, 1, "c\nC", False)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_measurements_read_each_number_once(spark):
    line = spark.createDataFrame([(1, "失重：≤ 2 mg/cm2 1.5 / 20 g/m2"), (2, "失重 ≤ 2 ≥ 1 1"), (3, "失重：无"), (4, None)], "k int, line string")
    found = rulepack.extract_measurements(line, ["k"], "line", packs.MEASUREMENTS)
    assert sorted((r["k"], r["limit_op"], r["limit"], r["values"], r["status"]) for r in found.collect()) == [(1, "≤", 2.0, [1.5, 2.0], "complete"), (2, None, None, [1.0], "unresolved"), (3, None, None, [], "unresolved")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2 * len(packs.MEASUREMENTS)


def test_exact_stage_goes_through_the_index(spark, sf_dir, monkeypatch):
    seen = []
    ingest = exact.DigestIndex.ingest
    monkeypatch.setattr(exact.DigestIndex, "ingest", lambda self, rows: seen.append(self) or ingest(self, rows))
    docs = spark.createDataFrame([(1, "a b"), (2, "ab  "), (None, "c"), (None, "c"), (4, "c"), (4, " c")], "doc_id long, text string")
    assert sorted(map(tuple, exact.stage(spark, docs, sf_dir).collect())) == [(2, "ab  "), (4, " c")]
    assert len(seen) == 1

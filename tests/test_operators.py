import functools
import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docsheaf.operators import compare, governance, matching, privacy, sampling, segments, verdicts, versions
from docsheaf.sources import files, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_newest_per_hash(spark):
    df = spark.createDataFrame([(1, "h"), (2, "h"), (3, None), (4, None)], "id int, h string")
    assert [r[0] for r in rows(versions.newest_per_hash(df, "h", "id"), "id")] == [2, 3, 4]


def test_version_chains(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4)], "id int, parent_id int")
    assert [r[0] for r in rows(versions.leaves(df).select("id"), "id")] == [3, 5]
    assert rows(versions.roots(df), "id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, o int")
    old = spark.createDataFrame([("a", 7)], "k string, version long")
    assert [r["version"] for r in versions.next_numbers(new, old, "k", "version", ["o"]).orderBy("k", "o").collect()] == [8, 9, 1]
    states = versions.activated(spark.createDataFrame([(1, "active"), (2, "draft"), (3, "archived")], "id int, status string"), F.col("id") == 2)
    assert rows(states.select("status", "id"), "id") == [("archived", 1), ("active", 2), ("archived", 3)]


@pytest.mark.parametrize("value,inclusive,state", [("5", False, "exceeds"), ("5", True, "within"), (None, True, "unknown"), ("5", None, "unknown"), ("9", True, "exceeds")])
def test_range_state(spark, value, inclusive, state):
    df = spark.createDataFrame([(value, inclusive)], "v string, i boolean")
    assert df.select(verdicts.range_state(F.col("v"), F.lit("5"), F.lit("8"), F.col("i"), F.lit(True))).first()[0] == state


def test_consensus(spark):
    data = [("conflict", "pass", "1", 1), ("conflict", "fail", "2", 2), ("evidence", "pass", "1", 1), ("evidence", "manual_review", "", 2), ("none", "manual_review", "", 3)]
    df = spark.createDataFrame(data, "item string, verdict string, reported string, segment int")
    evidenced = F.col("verdict").isin("pass", "fail") & (F.col("reported") != "")
    got = rows(verdicts.consensus(df, ["item"], "verdict", evidenced, "segment", "segment"), "item")
    assert got == [("conflict", "manual_review", True, [1, 2]), ("evidence", "pass", False, [1]), ("none", "manual_review", False, [3])]


def test_budget(spark):
    df = spark.createDataFrame([(1, k, r) for k, r in enumerate(["pass", "warn", "pass", "warn"])] + [(2, 0, "pass")], "d int, pos int, r string")
    got = rows(verdicts.budget(df, ["d"], "pos", F.col("r") == "pass", 2), "d", "pos")
    assert got == [(1, 1, "warn"), (1, 3, "warn"), (2, 0, "pass")]


def test_change_rates(spark):
    df = spark.createDataFrame([([10.0, 12.0], [9.0, 12.6], [-10.0, 4.0])], "b array<double>, a array<double>, r array<double>")
    calculated = verdicts.change_rates(F.col("b"), F.col("a"))
    row = df.select(calculated.alias("c"), verdicts.mismatched_columns(calculated, F.col("r")).alias("w")).first()
    assert row["c"] == [-10.0, 5.0] and row["w"] == [2]
    assert df.select(verdicts.minimum_thickness(F.lit(0.7), 0.9), verdicts.minimum_thickness(F.lit(1.2), 0.85)).first()[:] == (0.53, 0.92)


def test_chronology_and_hierarchy(spark):
    df = spark.createDataFrame([(["2024-03-05"], ["2024-03-01"], ["2024-03-09"]), (["2024-03-01"], ["2024-03-01"], ["2024-03-09"]), (["2024-03-01", "2024-03-02"], ["2024-03-03"], ["2024-03-09"])], "r array<string>, c array<string>, i array<string>")
    assert [r[0] for r in df.select(verdicts.chronology(F.col("r"), F.col("c"), F.col("i"))).collect()] == ["manual_review", "pass", "ambiguous"]
    ids = spark.createDataFrame([(["ABCD123456S", "ABCD1234561S"],), (["ABCD123456S"],), (["ABCD123456S", "XBCD1234561S"],), (["AB1S", "AB2S"],)], "v array<string>")
    assert [r[0] for r in ids.select(verdicts.hierarchy_consistent(F.col("v"))).collect()] == [True, False, False, False]


def test_input_guard_and_absences(spark):
    claims = spark.createDataFrame([(1, "s", ["a", "b"]), (2, "s", ["a"]), (3, "t", ["a"])], "claim_id int, sample string, needs array<string>")
    available = spark.createDataFrame([("s", "a"), ("t", "b")], "sample string, input string")
    got = verdicts.input_guard(claims, available, "sample", "needs").select("claim_id", "lacking", "stands")
    assert rows(got, "claim_id") == [(1, ["b"], False), (2, None, True), (3, ["a"], False)]
    findings = spark.createDataFrame([(1, "x", True, False), (2, "x", True, True), (3, "y", True, False)], "id int, item string, absence_only boolean, failed boolean")
    conditions = spark.createDataFrame([("x", False), ("y", None)], "item string, state boolean")
    assert [r[0] for r in rows(verdicts.withdrawn_absences(findings, conditions, ["item"]).select("id"), "id")] == [2, 3]


def test_steps_and_unique_matches(spark):
    df = spark.createDataFrame([(6.0,), (6.1,), (36.0,), (None,)], "d double")
    got = [r["m"] for r in matching.step_lookup(df, "d", [(6, 100.0), (10, 200.0), (25, 400.0)], 600.0, "m").collect()]
    assert got == [100.0, 200.0, 600.0, None]
    names = spark.createDataFrame([("YJV",), ("YJV 22",), ("RVV",)], "name string")
    texts = spark.createDataFrame([(1, "cable YJV-22 of type"), (2, "yjv only"), (3, "xyjv")], "id int, text string")
    hits = matching.contained_names(texts, "id", "text", names, "name")
    assert rows(matching.longest(hits, ["id"], "name").select("id", "name"), "id") == [(1, "YJV 22"), (2, "YJV")]
    twins = spark.createDataFrame([(1, "ab"), (1, "cd"), (2, "x")], "id int, name string")
    assert rows(matching.longest_unique(twins, ["id"], "name"), "id") == [(2, "x")]


def test_prefix_and_bands(spark):
    a = spark.createDataFrame([("东海电缆有限公司",), ("西海电缆有限",), ("短名",)], "n string")
    b = spark.createDataFrame([("东海电缆有限",)], "k string")
    assert rows(matching.prefix_compatible(a, b, "n", "k"), "n") == [("东海电缆有限公司", "东海电缆有限")]
    names = ["abcdef", "abcdefg", "abcdefgh", "abcdefx", "abcde", None, "abcdefghijklmno", "abcdefghijklmnop", "abcdef", "éééééé1"] + [f"abcdef{k:03d}" for k in range(40)]
    both = [spark.createDataFrame(list(enumerate(names)), f"{c}id int, {c} string") for c in "nk"]
    want = [(i, j) for i, x in enumerate(names) for j, y in enumerate(names) if x and y and min(len(x), len(y)) >= 6 and abs(len(x) - len(y)) <= 8 and (x.startswith(y) or y.startswith(x))]
    got = matching.prefix_compatible(*both, "n", "k")
    assert got.columns == ["nid", "n", "kid", "k"] and sorted((r["nid"], r["kid"]) for r in got.collect()) == sorted(want)
    gaps = spark.createDataFrame([(1, 1, 10.0), (2, 1, 50.0), (3, 2, 10.0)], "id int, page int, left double")
    boxes = spark.createDataFrame([(1, 12.0, "x"), (1, 51.0, "y"), (1, 49.0, "z")], "page int, left double, text string")
    assert rows(matching.band_matches(gaps, boxes, ["page"], ["left"], 3).select("id", "found"), "id") == [(1, "x"), (2, None), (3, None)]


def test_agreement_and_witness(spark):
    data = [(1, "5", "5", 0.99, 3), (1, "5", "5", 0.96, 4), (2, "5", "6", 0.99, 3), (2, "5", "6", 0.99, 4), (3, "5", "5", 0.99, 3)]
    df = spark.createDataFrame(data, "cell int, p string, r string, c double, s int")
    assert [x[-1] for x in rows(matching.agreed_readings(df, ["cell"], "p", "r", "c", "s"), "cell")] == [True, False, False]
    w = matching.witnessed(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], "v")
    assert rows(w.select("k", "v", "prior"), "k") == [(1, "x", "a"), (2, "b", None)]
    cat = spark.createDataFrame([("s", "1", "c1"), ("s", "2", "c2"), ("s", "3", "c2")], "std string, no string, concept string").withColumn("text", F.concat("std", "no"))
    cited = matching.cited(spark.createDataFrame([("s", "1", "x"), ("s", "9", "c1"), ("s", "9", "c2")], "std string, no string, concept string"), cat, ["std", "no"], "concept", "text")
    assert sorted(r["citation"] for r in cited.collect()) == ["blocked", "corrected", "valid"]


def test_pages_and_grids(spark):
    text = "--- Page 1 (ocr) ---\none\n--- Page 2 (text) ---\ntwo"
    good, twice = segments.pages(spark.createDataFrame([(1, text), (2, text + "\n--- Page 2 (ocr) ---\nx"), (3, "none")], "id int, t string"), "id", "t")
    assert rows(good, "page_no") == [(1, 1, "ocr", "one\n"), (1, 2, "text", "two")] and rows(twice, "id") == [(2,)]
    assert [[c[0] for c in r] for r in files.grids("<table><tr><td rowspan=2>A</td><td>B</td></tr><tr><td>C</td></tr></table>")[0]] == [["A", "B"], ["A", "C"]]
    html = "<table><tr><th>item</th><th>needed</th><th>result</th></tr><tr><td colspan=2>x &amp; y</td><td>1</td></tr></table>"
    grid = files.cells(spark.createDataFrame([(1, html), (2, None)], "page int, html string"), ["page"], "html")
    assert grid.count() == 6 and grid.filter("row_no = 1 and col_no = 1").first()["text"] == "x & y"
    assert files.header_rows(grid, ["page"], {"item": ["item"], "required": ["needed"], "result": ["result"]}).first()["header_row"] == 0
    blocks = spark.createDataFrame([(1, '[{"page_idx":0,"text":"a"},{"page_idx":1,"text":"c"},{"page_idx":0,"text":"b"}]')], "id int, b string")
    assert rows(files.block_pages(blocks, "id", "b"), "page_no") == [(1, 1, "a\nb"), (1, 2, "c")]


def test_specimens_and_lines(spark):
    data = [(1, 1, False, "A"), (1, 2, False, None), (1, 3, True, None), (1, 4, False, "A"), (1, 5, False, "B")]
    got = segments.specimens(spark.createDataFrame(data, "doc int, page int, cover boolean, k string"), "doc", "page", F.col("cover"), F.col("k"))
    assert [r["specimen"] for r in got.orderBy("page").collect()] == [1, 1, 2, 2, 3]
    words = spark.createDataFrame([(1, "b", 10.0, 0.0, 5.0), (1, "a", 11.0, 6.0, 9.0), (1, "c", 11.5, 40.0, 45.0), (1, "d", 14.0, 0.0, 3.0)], "page int, text string, top double, left double, right double")
    assert rows(segments.text_lines(words, ["page"]).select("line", "text"), "line") == [(0, "b a\tc"), (1, "d")]


def test_packing_in_order(spark):
    df = spark.createDataFrame([(d, k, n) for d in (1, 2) for k, n in enumerate([5, 5, 20, 1, 9, 1])], "d int, pos int, n int")
    assert [r["batch"] for r in segments.packed(df, "d", "pos", "n", 10).orderBy("d", "pos").collect()] == [0, 0, 1, 2, 2, 3] * 2


def test_redact_then_scan_finds_nothing(spark):
    rng = random.Random(1)
    parts = ["a.b@c.de", 'token = "' + "0a" * 20 + '"', "x", " ", "@", "token = ", "[email]", "secretname"]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(12)),) for _ in range(300)] + [(None,)], "text string")
    out = privacy.released(df)
    assert out.filter("not released").count() == 0
    known = df.filter("text is not null").select(privacy.redacted(F.col("text"), (), F.array(F.lit("secret"), F.lit("secretname")), "#").alias("t"))
    assert known.filter("t like '%secret%'").count() == 0 and known.filter("t like '%#name%'").count() == 0
    report = spark.createDataFrame([("申请编号 A2024CCC12345678 甲乙丙电缆有限公司",)], "text string").select(privacy.redacted(F.col("text"), privacy.REPORT).alias("t")).first()["t"]
    assert "甲乙丙" not in report and "2024" not in report


def test_first_wins_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, pos int, seg int")
    once = verdicts.first_wins(df, ["k"], ["pos"], "seg")
    assert rows(once, "k") == rows(verdicts.first_wins(once.drop("segments"), ["k"], ["pos"], "seg").drop("segments").join(once.select("k", "segments"), "k"), "k")


def test_smallest_cover_against_all_subsets():
    rng = random.Random(4)
    for _ in range(200):
        n, tasks = rng.randint(1, 9), rng.randint(1, 6)
        masks = {c: rng.randrange(1 << tasks) for c in range(n)}
        cost = {c: float(rng.randint(1, 5)) for c in range(n)}
        full = (1 << tasks) - 1
        found = sampling.smallest_cover(masks, cost, full)
        fits = [s for k in range(1, n + 1) for s in itertools.combinations(range(n), k) if not full & ~functools.reduce(int.__or__, (masks[c] for c in s))]
        if not fits:
            assert found is None
        else:
            best = min((len(s), sum(cost[c] for c in s)) for s in fits)
            assert (len(found), sum(cost[c] for c in found)) == best


def test_material_matching_is_largest():
    rng = random.Random(5)
    for _ in range(100):
        slots = {f"d{k}": [f"s{j}" for j in range(4) if rng.random() < 0.4] for k in range(4)}
        found = sampling.matched(slots)
        assert all(s in slots[d] for d, s in found.items()) and len(set(found.values())) == len(found)
        best = max(len({s for s in pick if s}) for pick in itertools.product(*[[None, *v] for v in slots.values()]) if len([s for s in pick if s]) == len({s for s in pick if s}))
        assert len(found) == best


def test_demands_and_bounds(spark):
    groups = spark.createDataFrame([("g", 3, 1), ("bad", 1, 2), ("done", 2, 2)], "g string, total int, filed int")
    items, bad = sampling.demands(groups, ["g"])
    assert rows(items, "g", "item_no") == [("g", 1), ("g", 2)] and [r["g"] for r in bad.collect()] == ["bad"]
    df = spark.createDataFrame([([0.5, 0.75, 1.0], None, None), (None, 1.0, 10.0), (None, 1.0, None)], "v array<double>, lo double, hi double")
    got = [r[0] for r in df.select(sampling.bounded(F.col("v"), F.col("lo"), F.col("hi"), F.lit(0.6), F.lit(8.0))).collect()]
    assert got[:2] == [[0.75, 1.0], [1.0, 8.0]]


def test_carry_rules(spark):
    df = spark.createDataFrame([(1.0, 1.5, 1, 2), (1.0, 2.5, 1, 3), (16.0, 25.0, 4, 5), (25.0, 25.0, 5, 5)], "a double, b double, ra int, rb int")
    assert [r[0] for r in df.select(sampling.carries(F.col("a"), F.col("b"), F.col("ra"), F.col("rb"))).collect()] == [True, False, False, True]


def test_similarity(spark):
    df = spark.createDataFrame([("绝缘 厚度", "绝缘厚度不足"), ("abcd", "abxd"), ("", "x"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(compare.similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and 0.5 < got[1] < 1 and got[2:] == [0.0, 0.0]


def test_governance(spark):
    rules = spark.createDataFrame([(1, "ok"), (2, "retired")], "id int, status string")
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    good, bad = governance.snapshot(rules, wanted, 4)
    assert [r["id"] for r in good.collect()] == [1] and sorted(r["id"] for r in bad.collect()) == [2, 3]
    df = spark.createDataFrame([({"b": " 2 ", "a": "1", "c": " "},)], "m map<string,string>")
    assert df.select(governance.rule_text(F.col("m"))).first()[0] == "a=1; b=2"
    texts = spark.createDataFrame([(1, "pvc rule", "x"), (2, "rubber rule", "y"), (3, "any", "z")], "id int, title string, rule_text string")
    assert governance.active_context(texts, "pvc", {"pvc": "pvc", "rubber": "rubber"}).first()["context"] == "pvc rule x\nany z"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text('{"units":[{"code":"u1","name":"U","models":[{"id":"m1","name":"M"}],"requirements":[{"id":"r","kind":"k","models":["m1","m9"]}]},{"code":"u1","name":"V","models":[],"requirements":[]}]}')
    units, models, errors = files.rule_package(spark, f"file://{tmp_path}/p")
    assert sorted(tuple(r) for r in errors.collect()) == [("duplicate_unit", "u1"), ("unknown_model", "m9")]
    assert len(files.catalogue(units, models).first()["models"]) == 1
    (tmp_path / "k/pvc").mkdir(parents=True)
    (tmp_path / "k/pvc/a.md").write_text("<!-- no -->\n# title\ntext")
    assert files.knowledge(spark, f"file://{tmp_path}/k", "pvc").first()["text"] == "text"
    (tmp_path / "u").mkdir()
    (tmp_path / "u/a.pdf").write_bytes(b"x")
    (tmp_path / "u/b.exe").write_bytes(b"x")
    ok, bad = files.uploads(spark, f"file://{tmp_path}/u", ["pdf"], 10)
    assert ok.count() == 1 and bad.first()["reason"] == "extension"
    df = spark.createDataFrame([(1, 'say "hi", \nthere', None)], "id int, t string, n string")
    sinks.write_csv(df, f"file://{tmp_path}/csv")
    back = spark.read.csv(f"file://{tmp_path}/csv", header=True, escape='"', multiLine=True).first()
    assert back["t"] == 'say "hi", \nthere'
    reason = sinks.failure_reason(F.lit("fail"), F.array(F.lit("a"), F.lit("b")), F.lit(""), F.lit("done"), F.lit("e"), F.lit("d"))
    assert spark.range(1).select(reason).first()[0] == "a；b"
    v = spark.createDataFrame([(1, 1)], "report_id int, version_no int")
    for n in (1, 2):
        sinks.append_versions(v, spark.createDataFrame([(1, f"f{n}")], "report_id int, item string"), f"file://{tmp_path}/r")
    assert spark.read.parquet(f"file://{tmp_path}/r/versions").count() == 2 and spark.read.parquet(f"file://{tmp_path}/r/findings").first()["item"] == "f2"
    assert "| a | b |" in sinks.markdown(spark.createDataFrame([(1, 0, "a", "b", None, "pass")], "k int, o int, item string, reported string, required string, verdict string"), "k", "o").first()["text"]


def test_tasks_from_audit_are_unique_or_none(spark):
    from docsheaf.operators import context

    texts = ["报告ID：12 任务 S7", "报告ID:12，任务S7", "报告ID：1 任务S8", "报告ID：1 任务S9", "报告ID：3", "任务S4", None, "报告ID：99999999999999999999 任务S1", "报告ID：4、报告ID：5 任务S2 任务S2"]
    audit = spark.createDataFrame([(t,) for t in texts], "detail string")
    reports = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 12, None)], "k long")
    bound = context.tasks_from_audit(reports, audit, "k", r"报告ID[：:]\s*(\d+)", r"任务\s*(S\d+)").collect()
    assert {r["k"]: r["task"] for r in bound} == {1: None, 2: None, 3: None, 4: "S2", 5: "S2", 12: "S7", None: None} and len(bound) == 7


def test_governance_summary_without_versions_and_runs(spark):
    from docsheaf.operators import summaries

    said = spark.createDataFrame([("pending", True), ("draft", False), (None, None)], "status string, enabled boolean")
    versions = spark.createDataFrame([(3, 4, "b", "active", "K1"), (2, 3, "a", "active", " "), (1, 1, "x", "archived", "K0"), (9, 9, "y", None, None)], "id long, version_no int, name string, status string, knowledge_version string")
    runs = spark.createDataFrame([(1, 5, 5, 0), (7, 6, 4, None)], "id long, total long, passed long, failed long")
    assert tuple(summaries.governance_summary(said, said, said, versions, runs, "K9").first()) == (1, 1, 1, 2, "V3", "a", "K9", 7, 6, 4, None)
    assert tuple(summaries.governance_summary(said, said, said, versions.limit(0), runs.limit(0)).first()) == (1, 1, 1, None, "基础版", "", "unknown", None, None, None, None)


def test_merge_policy_needs_an_active_rule(spark):
    from pyspark.sql import functions as F

    from docsheaf.operators import verdicts

    checks = spark.createDataFrame([(1, "a", 1, "pass", True), (1, "a", 2, "fail", True), (1, "b", 1, "pass", None)], "k int, p string, seg int, v string, e boolean")
    findings = spark.createDataFrame([(1, "a", 1, "x", "missing"), (1, "b", 1, "y", "missing"), (1, "b", 2, "z", None), (1, "b", 3, "z", ""), (None, "b", 1, "z", None)], "k int, p string, seg int, item string, reported string")
    findings = findings.withColumns({c: F.lit(None).cast("string") for c in ("should_be", "standard", "severity")})

    def run(*rows):
        rules = spark.createDataFrame(list(rows), "code string, kind string, status string, version int, id int")
        out = verdicts.merge_policy(findings, checks, rules, "m", ["k"], "p", "seg", "v", F.col("e"), F.col("reported") == "missing")
        return sorted((str(r["k"]), r["item"], r["segments"]) for r in out.collect())

    merged = [("1", "a分段结论冲突", [1, 2]), ("1", "y", [1]), ("1", "z", [2, 3]), ("None", "z", [1])]
    apart = [("1", "x", [1]), ("1", "y", [1]), ("1", "z", [2]), ("1", "z", [3]), ("None", "z", [1])]
    assert run(("m", "merge_policy", "active", 1, 1), ("m", "other", "archived", 2, 2)) == merged
    assert run(("m", "merge_policy", "active", 1, 1), ("m", "other", "active", 2, 2)) == apart
    assert run() == run(("n", "merge_policy", "active", 1, 1)) == run(("m", "merge_policy", None, 1, 1)) == apart


def test_similarity_takes_a_floor_per_row_and_best_matches_lose_nothing_to_it(spark):
    rows = [("abcd", "abxy", 0.5), ("abcd", "abxy", 0.6), ("a" * 3 + "b", "a" * 4 + "c" * 40, 0.25), ("abc", "xabcx", 0.9)]
    df = spark.createDataFrame(rows, "a string, b string, least double")
    assert [r[0] for r in df.select(compare.similarity(F.col("a"), F.col("b"), F.col("least"))).collect()] == [0.5, 0.0, 0.0, 1.0]
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))
    old, new = ([(c, i, word(), word()[:2]) for c in range(8) for i in range(4)] for _ in range(2))

    def plain(a, b):
        return 0.0 if not a or not b else 1.0 if a in b or b in a else SequenceMatcher(None, a, b).ratio()

    old.append((9, 0, "alone", ""))
    for least in (0.2, 0.48, 0.7):
        want = []
        for c, i, item, sample in old:
            score, j = max(((0.8 * plain(item, x) + (1 - 0.8) * plain(sample, y), -k) for d, k, x, y in new if d == c), default=(0.0, 0))
            want.append((c, i, -j, round(score, 6)) if score >= least else (c, i, None, None))
        got = compare.best_matches(*(spark.createDataFrame(r, "c int, id int, item string, sample string") for r in (old, new)), "c", least)
        assert sorted((r[0], r[1], r[2], r[3]) for r in got.collect()) == want

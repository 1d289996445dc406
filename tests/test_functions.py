import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsheaf.functions import normalize as N
from docsheaf.functions import scopes, specs
from docsheaf.operators import conditions
from tests.plain_conditions import evaluate


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("raw,status", [("吊销，未注销", "revoked"), ("注销", "cancelled"), ("迁出", "moved"), ("存续", "active"), ("", "unknown"), (None, "unknown"), ("其他", "other")])
def test_operating_status(spark, raw, status):
    assert one(spark, N.operating_status("a"), a=raw) == status


@pytest.mark.parametrize("name,category", [("绝缘厚度", "结构尺寸问题"), ("绝缘电阻", "电气性能问题"), ("老化后抗张强度", "机械性能问题"), ("外观", "其他问题"), (None, "其他问题")])
def test_finding_category(spark, name, category):
    assert one(spark, N.finding_category("a"), a=name) == category


def test_keys(spark):
    assert one(spark, N.company_key("a"), a="甲 乙(丙)　公司") == "甲乙（丙）公司"
    assert one(spark, N.identifier_key("a"), a="a-1 2/b") == "A12B"
    assert one(spark, N.without_category_prefix("a"), a="ZB-YJV") == "YJV"
    assert one(spark, N.folded("a"), a=" Ａ—１＋ ") == "A-1+"
    assert one(spark, N.key("a"), a="a b\tc") == "ABC"
    assert one(spark, N.model_code("a"), a="60227 IEC 53 （ rvv ）") == "60227 IEC 53(RVV)"


@pytest.mark.parametrize("raw,value", [("2.5 mm2", 2.5), (" -3 ", -3.0), ("2.5a", None), ("", None), (None, None), ("1e5", None), ("7毫米", 7.0)])
def test_strict_number(spark, raw, value):
    assert one(spark, N.strict_number("a"), a=raw) == value


@pytest.mark.parametrize("raw,value", [("Yes", True), ("是", True), ("0", False), ("maybe", None), (None, None)])
def test_strict_boolean(spark, raw, value):
    assert one(spark, N.strict_boolean("a"), a=raw) is value


def test_display_interval(spark):
    assert one(spark, N.display_change_overlap("b", "c", "r"), b="10.0", c="8.5", r="-15") is True
    assert one(spark, N.display_change_overlap("b", "c", "r"), b="10.0", c="8.5", r="-20") is False


def test_small_functions(spark):
    assert one(spark, N.half_away("a"), a=2.5) == 3 and one(spark, N.half_away("a"), a=-2.5) == -3
    assert one(spark, N.median_of(F.array(F.col("a"), F.lit(9.0), F.lit(1.0), F.lit(4.0))), a=2.0) == 3.0
    assert one(spark, N.first_value("a", "b"), a=" ", b=" x ") == "x"
    assert one(spark, N.json_object("a"), a='{"k": 1}') == {"k": "1"} and one(spark, N.json_object("a"), a="[1]") == {}
    assert one(spark, N.host_allowed("a", ["x.com"]), a="https://www.x.com/1") is True
    assert one(spark, N.host_allowed("a", ["x.com"]), a="https://evilx.com/1") is False
    assert one(spark, N.visible_text("a"), a="<b>x &amp; y</b>\n z") == "x & y z"
    assert one(spark, N.labelled_field("a", ["号码", "编号"], r"[A-Z0-9]+"), a="编号：AB12 x") == "AB12"
    assert one(spark, N.single(N.distinct_matches("a", r"\d+")), a="5 and 5") == "5"
    assert one(spark, N.single(N.distinct_matches("a", r"\d+")), a="5 and 6") is None
    assert one(spark, N.stage_percent(F.lit(10), F.lit(20), F.col("a"), F.lit(4)), a=2) == 15
    assert one(spark, N.keyword_score("a", {"x": 2.0, "y": 1.0}), a="xx") == 2.0


@pytest.mark.parametrize(
    "spec,facts",
    [("3×2×0.4+1×0.4", (7, 0.4)), ("3×2.5+1×1.5", (4, None)), ("2×(3×0.75)", (6, 0.75)), ("2.5", (None, None)), ("3×(2×0.75", (None, None)), (None, (None, None)), ("(3×1.5)", (3, 1.5)), ("0×1.5", (None, None)), ("3 x 2.50 mm2", (3, 2.5))],
)
def test_spec_facts(spark, spec, facts):
    row = specs.with_spec_facts(spark.createDataFrame([(1, spec)], "id int, spec string")).first()
    assert (row["core_count"], row["section"]) == facts


def test_canonical_spec(spark):
    rows = specs.with_spec_facts(spark.createDataFrame([(" 3 x 2.50 mm2",), ("3×10",), ("2*(3×0.750)",), ("abc",)], "spec string")).collect()
    assert {r["spec"]: r["canonical_spec"] for r in rows} == {" 3 x 2.50 mm2": "3×2.5mm²", "3×10": "3×10mm²", "2*(3×0.750)": "2×(3×0.75)mm²", "abc": None}


SCHEMA = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType())])


def tree(rng, depth=0):
    if depth < 3 and rng.random() < 0.55:
        op = rng.choice(["all", "any", "not"])
        return {"op": "not", "rule": tree(rng, depth + 1)} if op == "not" else {"op": op, "rules": [tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]}
    op = rng.choice(["<", "<=", ">", ">=", "==", "in", "not_in", "between", "~"])
    value = rng.choice([1, 2.5, "2", "a", True, None, float("inf")])
    return {"op": op, "field": rng.choice(["x", "s", "b", "missing"]), "value": rng.choice([[value, 2, "a"], None, []]) if op in ("in", "not_in") else value, "min": rng.choice([0, "1", None]), "max": rng.choice([2, 9])}


def test_compiled_trees_agree_with_python(spark):
    rng = random.Random(11)
    rows = [(x, s, b) for x in (None, 1.0, 2.5) for s in (None, "2", "a") for b in (None, True, False)]
    trees = [tree(rng) for _ in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select(*[conditions.compile_condition(t, SCHEMA).alias(f"t{k}") for k, t in enumerate(trees)], "x", "s", "b").collect()
    for r in got:
        facts = {k: r[k] for k in ("x", "s", "b") if r[k] is not None}
        for k, t in enumerate(trees):
            assert r[f"t{k}"] is evaluate(t, facts), (t, facts)


@pytest.mark.parametrize(
    "node,facts,state",
    [
        ({"op": "all", "rules": []}, {}, None),
        ({"op": "any", "rules": []}, {}, None),
        ({"op": "<", "field": "x", "value": 5}, {}, None),
        ({"op": "<", "field": "x", "value": 5}, {"x": True}, None),
        ({"op": "<", "field": "x", "value": 5}, {"x": "abc"}, None),
        ({"op": "==", "field": "x", "value": 3}, {"x": "3"}, False),
        ({"op": "in", "field": "x", "value": None}, {"x": 1}, False),
        ({"op": "not_in", "field": "x", "value": None}, {"x": 1}, True),
        ({"op": "~", "field": "x", "value": 1}, {"x": 1}, None),
    ],
)
def test_condition_cases(node, facts, state):
    assert evaluate(node, facts) is state


def test_conflicts_are_unknown(spark):
    df = spark.createDataFrame([(1.0, ["x"]), (1.0, []), (1.0, None)], "x double, c array<string>")
    got = [r["o"] for r in df.select(conditions.compile_condition({"op": "<", "field": "x", "value": 5}, df.schema, F.col("c")).alias("o")).collect()]
    assert got == [None, True, True]


def test_scope_segments():
    got = scopes.scope_segments("0.08-0.4(2芯), 0.12-0.4(3-8芯)")
    assert [(s["section_min"], s["section_max"], s["core_min"], s["core_max"]) for s in got] == [(0.08, 0.4, 2, 2), (0.12, 0.4, 3, 8)]
    assert scopes.scope_segments("1.5(2芯,3芯) 扁形") == [{"section_min": 1.5, "section_max": 1.5, "core_min": 2, "core_max": 3, "core_values": [2, 3], "shapes": ["flat"], "special": ""}]
    assert scopes.scope_segments("3×0.5+1×0.4") is None and scopes.scope_segments("x(2芯)") is None

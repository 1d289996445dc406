"""Cases that must not pass: missing fields, equal local ids of different documents, wrong units, null groups, cycles."""

from datetime import datetime, timedelta

import pytest

from docsheaf.functions import reports
from docsheaf.operators import context, packs, rulepack, segments, versions
from docsheaf.streaming import intake


def test_row_sets_with_nulls_are_incomplete(spark):
    rows = [(1, s, f) for s in ("before", "after") for f in ("a", "b")] + [(2, "before", "a"), (2, "before", "b"), (2, "after", "a"), (2, "after", None)]
    rows += [(3, "before", "a"), (3, "before", "b"), (3, None, "a"), (3, "after", "b")]
    df = spark.createDataFrame(rows, "g int, stage string, field string")
    assert [r["g"] for r in context.complete_row_sets(df, ["g"], "stage", "field", ["before", "after"], ["a", "b"]).collect()] == [1]


def test_support_stays_in_its_document(spark):
    cells = spark.createDataFrame([(d, "t0r0c0", 0.7, t, 0.0, 9.0, 0.0, 9.0) for d, t in ((1, "A"), (2, "B"), (3, "C"))], "doc int, cell_id string, confidence double, text string, left double, right double, top double, bottom double")
    characters = spark.createDataFrame([(1, 1.0, 1.0, "A", False), (2, 1.0, 1.0, "B", False)], "doc int, x double, y double, char string, hidden boolean")
    assert {r["doc"]: r["supported"] for r in context.supported_cells(cells, characters, ["doc"]).collect()} == {1: True, 2: True, 3: False}


@pytest.mark.parametrize("headers,identity,reason", [(["A"], "A", None), (["A", "B"], None, "conflict"), (["B"], None, "conflict"), ([None, " "], "A", None)])
def test_identity_needs_all_headers(spark, headers, identity, reason):
    df = spark.createDataFrame([(1, "A", h) for h in headers], "k int, cover string, header string")
    assert tuple(context.checked_identity(df, "k", "cover", "header").first()) == (1, identity, reason)


@pytest.mark.parametrize(
    "line,values,limit,status",
    [
        ("抗张强度：≥ 10.0 10.5 N/mm2", [10.5], 10.0, "complete"),
        ("抗张强度：≥10 N/mm² 12.5MPa 13 N/mm2", [12.5, 13.0], 10.0, "complete"),
        ("失重：1.2 mg/cm2", [1.2], None, "complete"),
        ("失重：12 g/m²", [1.2], None, "complete"),
        ("绝缘平均厚度：0.7 kN", [None], None, "unresolved"),
        ("绝缘平均厚度：0.07 cm", [0.7], None, "complete"),
        ("绝缘平均厚度：≥0.6kN 0.7", [0.7], None, "unresolved"),
        ("绝缘平均厚度：0.7", [0.7], None, "complete"),
        ("绝缘平均厚度：mm", [], None, "unresolved"),
        ("绝缘平均厚度：≥0.5 ≥0.6 0.7", [0.7], None, "unresolved"),
        ("断裂伸长率：150 %", [150.0], None, "complete"),
    ],
)
def test_units_are_read(spark, line, values, limit, status):
    found = rulepack.extract_measurements(spark.createDataFrame([(1, line)], "k int, line string"), ["k"], "line", packs.MEASUREMENTS).collect()
    assert len(found) == 1
    assert [v if v is None else round(v, 9) for v in found[0]["values"]] == values
    assert (found[0]["limit"], found[0]["status"]) == (limit, status)


def test_rows_without_a_document_keep_the_budget(spark):
    big = 2**60
    rows = [(None, 1, 5), (None, 2, 5), (None, 3, 20), (big, 1, 7), (big, 2, 7), (big + 1, 1, 5), (big + 1, 2, None)]
    df = spark.createDataFrame(rows, "d long, pos int, n int")
    assert {(r["d"], r["pos"]): r["batch"] for r in segments.packed(df, "d", "pos", "n", 12).collect()} == {(None, 1): 0, (None, 2): 0, (None, 3): 1, (big, 1): 0, (big, 2): 1, (big + 1, 1): 0, (big + 1, 2): 0}


def test_null_users_lock_too(spark):
    at = datetime(2024, 1, 1)
    rows = [(u, at + timedelta(minutes=m), True) for u in (None, 5) for m in (0, 1)] + [(5, None, True), (7, at, None), (7, at, True)]
    locked = intake.lock_outs_batch(spark.createDataFrame(rows, "user_id long, at timestamp, failed boolean"), 2, 10).collect()
    assert sorted((str(r["user_id"]), r["until"]) for r in locked) == [("5", at + timedelta(minutes=11)), ("None", at + timedelta(minutes=11))]


def test_cycles_end_without_a_root(spark):
    edges = [(1, None), (2, 1), (3, 2), (10, 11), (11, 10), (20, 21), (21, 22), (22, 20), (23, 22), (30, 31), (31, 32), (32, 33), (33, 30), (40, 99), (50, 50)] + [(100 + k, 99 + k if k else None) for k in range(20)]
    found = {r["id"]: r["root_id"] for r in versions.roots(spark.createDataFrame(edges, "id int, parent_id int")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 40: 99, 50: 50} | dict.fromkeys([10, 11, 20, 21, 22, 23, 30, 31, 32, 33]) | {100 + k: 100 for k in range(20)}


@pytest.mark.parametrize("name,good", [("远东电缆有限公司", True), ("张三(个体工商户)", True), ("厂", False), ("委托人地址有限公司", False), ("A123电缆厂", False), ("12电缆厂", True), ("5000米电缆厂", True), ("5000米 电缆厂", False), ("检验结果公司", False), ("甲：公司", False), ("甲电缆", False)])
def test_company_names(name, good):
    assert reports._company_name(name) == good

from docsheaf.functions import reports
from docsheaf.operators import requirements


def test_company_candidates():
    one = reports.company_candidates
    assert one("委托人：甲乙丙电缆有限公司\n") == [(0, "甲乙丙电缆有限公司")]
    assert one("委\n托\n人：甲乙\n丙有限公司\n厂") == [(0, "甲乙丙有限公司"), (0, "甲乙丙有限公司厂")]
    assert one("委托人不得复制公司") == [] and one(None) == []
    assert one("制造商：<td>甲乙丙厂</td>报告编号 1\n申请人 ：丁戊集团") == [(0, "丁戊集团"), (1, "甲乙丙厂")]
    assert reports.company_of([(0, "甲乙丙有限公司"), (0, "甲乙丙有限公司厂"), (1, "别家厂")]) == "甲乙丙有限公司厂"
    assert reports.company_of([(0, "甲乙丙电缆有限公司"), (0, "丁戊己电缆有限公司")]) is None and reports.company_of([]) is None


def test_swaps_lower_the_cost_of_a_plan():
    costs = {1: {"a": 4.0, "b": 4.0}, 2: {"a": 0.0}, 3: {"b": 1.0}, 4: {"a": 1.0, "b": 1.0}}
    assert requirements.improved([1], costs, ["a", "b"]) == [4]
    assert requirements.improved([1, 2], costs, ["a", "b"]) == [2, 3]
    assert requirements.improved([4], costs, ["a", "b"]) == [4]


def test_clean_scope_and_core_values(spark):
    df = spark.createDataFrame([("0.5 – 1 mm²（2 芯 ）， 扁形；", "(2芯) (3-8芯) (2x3芯) (x)")], "t string, c string")
    assert tuple(df.select(reports.clean_scope("t"), reports.core_values("c")).first()) == ("0.5-1(2芯), 扁形", [2, 3, 8, 6])

"""Queries over texts made of the driver's columns, so that SQL knows what the text functions must find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.functions import normalize as N
from docsheaf.functions import reports as R
from docsheaf.plans.tables import dealt, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def said(*parts: str | Column) -> Column:
    """Strings and columns, one after the other; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part"), "p_partkey")


def part_key() -> Column:
    return F.col("p_partkey")


def part_size() -> Column:
    return F.col("p_size")


def part_type() -> Column:
    return F.col("p_type")


@registered("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type ELSE p_type || CASE WHEN p_partkey % 3 = 1 THEN ' plain' ELSE '' END END AS model, CASE WHEN p_partkey % 3 <> 1 THEN '300/500V' ELSE '' END AS voltage,
CASE p_partkey % 3 WHEN 0 THEN p_size || '×2.5mm²' WHEN 1 THEN '' ELSE p_size || '.50mm²' END AS spec, CASE WHEN p_partkey % 3 = 0 THEN p_type || '|300/500V|' || p_size || '×2.5mm²|P' || p_partkey END AS same FROM part""")
def sample_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(part_key() % 3 == 0, said(part_type(), "&nbsp;300 / 500 ", part_size(), " x 2.50 mm2")).when(part_key() % 3 == 1, said(part_type(), " plain")).otherwise(said("<b>", part_type(), "</b>：300/500V ", part_size(), ".50 mm2"))
    df = parts(spark, sf_dir).select("p_partkey", R.sample_identity(text).alias("i")).select("p_partkey", "i.*")
    key = R.identity_key(F.col("model"), F.col("voltage"), F.col("spec"), said("p-", part_key()))
    return df.withColumn("same", F.when(part_key() % 3 == 0, F.concat_ws("|", key["model"], key["voltage"], key["spec"], key["specimen"])))


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN '5023.' || p_size END AS standard, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 9)::VARCHAR END AS table_no, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 7) || '.2' END AS item,
'GB 5023.' || p_size || ' 表' || p_partkey % 9 || ' 项次' || p_partkey % 7 AS named, concat_ws(' ', 'GB 5023', '表' || p_partkey % 9, CASE WHEN p_partkey % 7 > 0 THEN '项次' || p_partkey % 7 END) AS reference FROM part""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = said("按GB/T 5023.", part_size(), "-2008 ", F.when(part_key() % 4 == 0, "附录").otherwise("表 "), part_key() % 9, " 项次 ", part_key() % 7, ".2")
    c = R.citation(text)
    standard, number = said("GB 5023.", part_size()), F.when(part_key() % 7 > 0, (part_key() % 7).cast("string")).otherwise("—")
    table_no = F.when(part_key() % 2 == 0, said(part_key() % 9)).otherwise(said("表", part_key() % 9))
    return parts(spark, sf_dir).select("p_partkey", c["standard"].alias("standard"), c["table"].alias("table_no"), c["item"].alias("item"), R.catalogue_citation(standard, said("表", part_key() % 9), said(part_key() % 7)).alias("named"), R.matrix_reference(F.lit(" GB 5023 "), table_no, number).alias("reference"))


_WORDS, _CODES = (", ".join(f"'{x[k]}'" for x in R.CONCEPTS) for k in (0, 1))


@registered(f"""WITH t AS (SELECT p_partkey, ['绝缘', '护套', ''][p_partkey % 3 + 1] || ([{_WORDS}])[p_partkey % 30 + 1] || '试验' AS text, ([{_CODES}])[p_partkey % 30 + 1] AS code, p_partkey % 5 = 0 AS loss FROM part)
SELECT p_partkey, CASE WHEN contains(text, '护套') THEN 'sheath:' WHEN contains(text, '绝缘') OR loss THEN 'insulation:' ELSE '' END || code AS concept FROM t""")
def item_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w, _ in R.CONCEPTS])
    text = F.concat(F.element_at(F.array(*map(F.lit, ("绝缘", "护套", ""))), (part_key() % 3 + 1).cast("int")), F.element_at(words, (part_key() % 30 + 1).cast("int")), F.lit("试验"))
    return parts(spark, sf_dir).select("p_partkey", R.item_concept(text, F.when(part_key() % 5 == 0, "loss_weight")).alias("concept"))


@registered("SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'pvc' WHEN 2 THEN 'rubber' WHEN 3 THEN 'rubber' END AS family FROM part")
def standard_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = said(part_type(), F.when(part_key() % 2 == 1, "聚氯乙烯").otherwise(""), F.when(part_key() % 4 >= 2, " 橡皮").otherwise(""))
    return parts(spark, sf_dir).select("p_partkey", R.standard_family(text).alias("family"))


@registered("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'RVV 300/500V ' || p_size || '×1.5mm²' WHEN 1 THEN 'YZ 300/500 1×' || p_size || 'mm²' WHEN 2 THEN '60245 IEC ' || p_size || ' (YZ)' ELSE '样品' || p_partkey END AS label FROM part""")
def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(part_key() % 4 == 0, said("样品 RVV  300/500V ", part_size(), "×1.5mm²，")).when(part_key() % 4 == 1, said("YZ 300/500 ", part_size(), " mm2 。")).when(part_key() % 4 == 2, said("型号：60245  IEC ", part_size(), " （YZ）")).otherwise("未注明")
    return parts(spark, sf_dir).select("p_partkey", R.sample_label(text, part_key()).alias("label"))


@registered("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 END AS cores, CASE WHEN p_partkey % 3 < 2 THEN 1.5 END::DOUBLE AS section, CASE WHEN p_partkey % 2 = 0 THEN '450/750V' END AS voltage FROM part""")
def primary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.when(part_key() % 3 == 0, said(part_size(), " × 1.5")).when(part_key() % 3 == 1, said(part_size(), "x1.5+1×0.75")).otherwise("见附页")
    text = said("编号 9×9 ", F.lit("x").cast("string"), "\n试样型号和 规格：", spec, F.when(part_key() % 2 == 0, " 450 / 750 V").otherwise(" 10 V"))
    s = R.primary_spec(text)
    return parts(spark, sf_dir).select("p_partkey", s["cores"].alias("cores"), s["section"].alias("section"), R.rated_voltage(text).alias("voltage"))


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END::DOUBLE AS amps, 300::DOUBLE AS volts, NULL::DOUBLE AS kg, p_size || '.5,' || (-p_partkey) || CASE WHEN p_partkey % 2 = 0 THEN ',7' ELSE '' END AS nums FROM part""")
def labelled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = said("曲挠参数：", part_size(), " A, 300V", F.when(part_key() % 3 == 0, said(" 1", part_size(), " A")).otherwise(""), "\n其他 5 kg\n抗张强度\n ", part_size(), ".5\n 文字\n-", part_key(), "\n", F.when(part_key() % 2 == 0, "7\n").otherwise(""), "判定 P\n8\n")
    n = R.labelled_numbers(text, "曲挠参数", ["A", "V", "kg"])
    values = F.array_join(F.transform(R.values_after(text, "抗张强度", "判定"), lambda v: F.format_string("%s", v.cast("decimal(20,1)"))), ",")
    return parts(spark, sf_dir).select("p_partkey", n["A"].alias("amps"), n["V"].alias("volts"), n["kg"].alias("kg"), F.regexp_replace(values, r"\.0(?=,|$)", "").alias("nums"))


@registered(r"""WITH c AS (SELECT doc_id, '□' || coalesce(text, '') AS t, trim('□' || coalesce(text, ''), E' \t\n\r') AS b FROM documents),
g AS (SELECT *, len(b) - len(replace(replace(b, '�', ''), '□', '')) AS bad, len(list_filter(regexp_split_to_array(b, '\r?\n'), lambda x: trim(x) <> '')) AS n FROM c)
SELECT doc_id, bad <= 0.01 * len(b) AS usable, len(t) >= 100 AND len(regexp_extract_all(t, '[一-鿿]')) >= 30 AS chinese, bad <= 0.01 * (len(b) + 100) AND n >= 5 AS rows_seen FROM g""")
def text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind a damaged character; and as dense tables with numbers and length added, so that lines decide."""
    docs, text = table(spark, sf_dir, "documents"), F.concat(F.lit("□"), F.coalesce(F.col("text"), F.lit("")))
    dense = F.concat(F.btrim(text, F.lit(" \t\n\r")), F.lit("标准要求 检验结果 1 2 3" + "x" * 85))
    return docs.select("doc_id", R.text_layer_usable(text).alias("usable"), R.readable_chinese(text).alias("chinese"), R.text_layer_usable(dense).alias("rows_seen"))


@registered("SELECT p_partkey, p_partkey % 4 IN (0, 1) OR (p_partkey % 4 = 2 AND p_size % 2 = 0) AS collapsed FROM part")
def collapsed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "<table><tr><td>检测项目</td><td>标准要求</td><td>检验结果</td></tr>"
    hollow = head + '<tr><td rowspan="13">x</td></tr>' + "<tr><td> &nbsp;</td></tr>" * 6 + "<tr><td>1</td></tr>" * 5 + "</table>"
    crowded = head + "<tr><td>老化前抗张强度 老化后抗张强度 失重试验 热冲击试验</td></tr></table>"
    triplet = [head + f"<tr><td>高温压力 热冲击试验 低温弯曲试验 {x}</td></tr></table>" for x in ("试验条件：80℃\n施加压力 3N", "无条件")]
    html = F.when(part_key() % 4 == 0, hollow).when(part_key() % 4 == 1, crowded).when(part_key() % 4 == 2, F.when(part_size() % 2 == 0, triplet[0]).otherwise(triplet[1])).otherwise(hollow.replace("标准要求", "要求"))
    return parts(spark, sf_dir).select("p_partkey", R.collapsed_table(said("<p>", part_type(), "</p>", html)).alias("collapsed"))


@registered("""SELECT p_partkey, p_partkey % 5 IN (0, 1, 2) OR p_partkey % 7 = 0 AS asks_nothing, p_partkey % 3 = 0 AS missing, p_partkey % 3 <> 0 AND p_size % 4 <> 0 AND p_size % 5 <> 0 AS evidence,
CASE p_partkey % 4 WHEN 0 THEN '绝缘,护套' WHEN 1 THEN '护套' ELSE '' END AS scope FROM part""")
def finding_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    should = F.when(part_key() % 5 == 0, "报告无需修改").when(part_key() % 5 == 1, "该项判定正确").when(part_key() % 5 == 2, "保持原值").when(part_key() % 5 == 3, "应为不合格").otherwise("请更正")
    note = F.when(part_key() % 3 == 0, "样品信息未提供").otherwise("已核对")
    reported = F.when(part_size() % 5 == 0, " ").otherwise(part_size().cast("string"))
    verdict = F.when(part_size() % 4 == 0, "manual_review").otherwise("pass")
    title = F.when(part_key() % 4 == 0, "绝缘和护套老化").when(part_key() % 4 == 1, "护套低温拉伸").when(part_key() % 4 == 2, "绝缘电阻").otherwise("外径")
    return parts(spark, sf_dir).select("p_partkey", R.asks_nothing(should, F.lit("复核"), part_key() % 7 != 0).alias("asks_nothing"), R.missing_record(F.lit("x"), note).alias("missing"), R.has_evidence(verdict, reported, note).alias("evidence"), F.array_join(R.component_scope(title), ",").alias("scope"))


@registered("""SELECT p_partkey, p_size || ',' || (p_size + 3) || ',' || 2 * p_size AS cores, '0.5-1.5(' || p_size || '-' || (p_size + 3) || '芯), 2.5(' || p_size || '×2芯)' AS clean, true AS found, p_partkey % 2 = 0 AS found_loose FROM part""")
def scope_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = said("0.5 － 1.5mm² （ ", part_size(), " - ", part_size() + 3, " 芯）2.5 mm2(", part_size(), " x 2芯) ；")
    number = said("A", part_key(), "-X/7")
    spelled = F.when(part_key() % 2 == 0, said("no a", part_key(), " _ x 7 end")).otherwise(said("A", part_key(), ".X/7"))
    found = lambda text, loose: F.regexp_like(text, R.fuzzy_pattern(number, loose))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(R.core_values(scope).cast("array<string>"), ",").alias("cores"), R.clean_scope(scope).alias("clean"), found(said("x A", part_key(), " - X /7"), False).alias("found"), found(spelled, True).alias("found_loose"))


@registered("""SELECT p_partkey, p_type AS shown, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS changes, CASE WHEN p_partkey % 3 = 0 THEN 'old' END AS previous,
'AB-' || p_partkey || '-1' || CASE WHEN p_partkey % 2 = 0 THEN ',CD.' || p_partkey ELSE '' END AS specimens FROM part""")
def display_and_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(part_key() % 3 == 0, "old").when(part_key() % 3 == 1, part_type())
    value, history = R.synced_display(F.coalesce(shown, part_type()), part_type(), "reported_value", F.lit(None).cast("array<struct<field:string,previous:string,current:string,reason:string>>"))
    text = said("检验编号：AB－", part_key(), " —1 <br> 检验编号: .CD.", part_key(), " 报告编号 ", F.when(part_key() % 2 == 0, "CD.").otherwise("EF."), part_key(), " 检验编号 AB-", part_key(), "-1")
    return parts(spark, sf_dir).select("p_partkey", value.alias("shown"), F.size(history).alias("changes"), F.get(history, F.lit(0))["previous"].alias("previous"), F.array_join(R.specimen_numbers(text), ",").alias("specimens"))


_NAME = "translate(o_custkey::VARCHAR, '0123456789', '甲乙丙丁戊己庚辛壬癸')"


@registered(f"""SELECT o_orderkey, 'R' || o_orderkey AS report_no, CASE WHEN o_orderkey % 3 <> 0 THEN 'A-' || o_custkey WHEN o_orderkey % 5 = 4 THEN 'X' END AS application_no, '电缆' || o_custkey AS product_unit,
CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN {_NAME} || '生产有限公司' ELSE {_NAME} || '电缆有限公司' END AS company FROM orders""")
def report_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with split labels, wrapped names, names of other roles, and two names that exclude each other."""
    key, name = F.col("o_orderkey"), F.translate(F.col("o_custkey").cast("string"), "0123456789", "甲乙丙丁戊己庚辛壬癸")
    kind = key % 5
    who = (
        F.when(kind == 0, said("委托人：", name, "电缆有限公司\n申请人：乙方", name, "工厂"))
        .when(kind == 1, said("生产者:", name, "生产有限公司 地址\n生产企业：", name, "厂"))
        .when(kind == 2, said("委\n托\n人：", name, "电缆\n有限公司\n报告编号"))
        .when(kind == 3, said("委托单位\n", name, "电缆有限公司\n委托人地址：某路1号有限公司\n制造商：别家公司"))
        .otherwise(said("委托人：", name, "电缆有限公司申请编号 X\n委托人不得复制公司"))
    )
    text = said("No. R", key, "\n申请编号：", F.when(key % 3 == 0, "/").otherwise(said("A-", F.col("o_custkey"))), "\n产品名称 ：电缆", F.col("o_custkey"), "\n", F.when(kind == 1, F.replace(who, F.lit(" 地址"), F.lit(""))).otherwise(who))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.report_header(text).alias("h")).select("o_orderkey", "h.*")


@registered("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a b c' || p_type ELSE 'A-1' END AS folded, upper(p_brand || p_type) AS key, 'RVV(' || p_size || ')-Z' AS code, 'RVV-' || p_size AS base, '东海（' || p_size || '）公司' AS company, 'AB' || p_size AS ident,
CASE WHEN p_partkey % 3 = 0 THEN p_size END::DOUBLE AS number, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR END AS member, p_type AS first, CASE p_partkey % 4 WHEN 0 THEN 'revoked' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'active' ELSE 'unknown' END AS status,
(25 * (p_partkey % 3) + 10)::INT AS percent, p_type || ' <b> & x' AS visible, p_size % 4 AS median FROM part""")
def normalised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar normalisers and strict parsers side by side."""
    text = F.when(part_key() % 2 == 0, said(" ａ b　ｃ", part_type(), " ")).otherwise("Ａ－１")
    number = F.when(part_key() % 3 == 0, said(" ", part_size(), " mm2")).otherwise(said(part_size(), " mm2 x"))
    flag = F.when(part_key() % 3 == 0, "是").when(part_key() % 3 == 1, " No ").otherwise("maybe")
    status = F.when(part_key() % 4 == 0, "吊销，未注销").when(part_key() % 4 == 1, "已 注销").when(part_key() % 4 == 2, "存续").otherwise(" ")
    json = F.when(part_key() % 3 == 0, said('{"s": ', part_size(), "}")).otherwise("[1]")
    return parts(spark, sf_dir).select(
        "p_partkey",
        N.folded(text).alias("folded"),
        N.key(F.concat(F.lower("p_brand"), F.lit(" \t"), part_type())).alias("key"),
        N.model_code(said(" rvv （", part_size(), "） - z")).alias("code"),
        N.without_category_prefix(said("ZB-RVV-", part_size())).alias("base"),
        N.company_key(said("东海 (", part_size(), ") 公司")).alias("company"),
        N.identifier_key(said("a-b ", part_size(), "/")).alias("ident"),
        N.strict_number(number).alias("number"),
        N.strict_boolean(flag).alias("flag"),
        N.json_object(json)["s"].alias("member"),
        N.first_value(F.lit(" "), F.lit(None).cast("string"), part_type()).alias("first"),
        N.operating_status(status).alias("status"),
        N.stage_percent(F.lit(10), F.lit(60), (part_key() % 3).cast("double"), F.lit(2.0)).alias("percent"),
        N.visible_text(said("<p>", part_type(), "</p><script>var x</script>&lt;b&gt; &amp;  x")).alias("visible"),
        N.median_of(F.array(part_size() % 4, F.lit(-1), F.lit(9))).cast("int").alias("median"),
    )

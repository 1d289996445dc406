"""Rule contexts, facts of samples, and rows bound to their sources, each unique or left open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsheaf.functions import normalize as N
from docsheaf.functions import reports as R
from docsheaf.operators import conditions, selection


def chosen_models(texts: DataFrame, models: DataFrame, key: str, band: int = 15, most: int = 4) -> DataFrame:
    """(key, model_id, score): model codes and aliases that a text names, without those inside a longer hit, the best few.

    ``texts`` has (key, token) rows of what it names; ``models`` has model_id, code, aliases (array).  A full code scores
    100, an alias 20, and a hit with a space 30 more.  Of the models that share a name and a score, only the first ``most``
    can be among a key's best, so no more are joined, however many models a name has.
    """
    names = models.select("model_id", F.explode(F.concat(F.array(F.struct(N.model_code("code").alias("name"), F.lit(100).alias("score"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(N.model_code(a).alias("name"), F.lit(20).alias("score"))))).alias("n")).select("model_id", "n.*").filter("name <> ''")
    names = selection.capped(names.withColumn("score", F.col("score") + F.when(F.contains("name", F.lit(" ")), 30).otherwise(0)).distinct(), ["name", "score"], [F.col("model_id")], most)
    named = names.groupBy("name").agg(F.collect_list(F.struct("model_id", "score")).alias("models"))
    hits = texts.filter(F.col(key).isNotNull()).select(key, N.model_code("token").alias("name")).join(named, "name")
    inside = lambda h, o: (F.length(o["name"]) > F.length(h["name"])) & F.contains(o["name"], h["name"])
    per = hits.groupBy(key).agg(F.collect_set(F.struct("name", "models")).alias("__all"))
    alone = F.filter("__all", lambda h: ~F.exists("__all", lambda o: inside(h, o)))
    per = per.select(key, F.flatten(F.transform(alone, lambda h: h["models"])).alias("__models"))
    top = lambda i: F.array_max(F.transform(F.filter("__models", lambda m: m["model_id"].eqNullSafe(i)), lambda m: m["score"]))
    ids = F.array_distinct(F.transform("__models", lambda m: m["model_id"]))
    per = per.select(key, F.array_sort(F.transform(ids, lambda i: F.struct((-top(i)).alias("less"), i.alias("model_id")))).alias("__best"))
    near = F.slice(F.filter("__best", lambda b: b["less"] <= F.get("__best", F.lit(0))["less"] + band), 1, most)
    return per.select(key, F.posexplode(near).alias("pos", "b")).select(key, "b.model_id", (-F.col("b.less")).alias("score"), (F.col("pos") + 1).alias("rank"))


def shared_models(chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(keys, chosen) of chosen models (key, model_id, series_id): the keys with their ``choice``, and each choice's models once.

    Keys that chose the same models and series get the same rules, so those are looked up once for a choice.
    """
    pairs = F.array_sort(F.collect_set(F.struct("model_id", "series_id")))
    keys = chosen.filter(F.col(key).isNotNull()).groupBy(key).agg(pairs.alias("__pairs")).withColumn("choice", F.to_json("__pairs"))
    return keys.select(key, "choice"), keys.groupBy("choice").agg(F.first("__pairs").alias("__pairs")).select("choice", F.explode("__pairs").alias("p")).select("choice", "p.*")


def rule_parameters(chosen: DataFrame, matrix: DataFrame, methods: DataFrame, parameters: DataFrame, key: str, most: int = 60) -> DataFrame:
    """Parameters of the methods that chosen models (key, model_id, series_id) need, each once, the most urgent first.

    Methods are those that a model's verified matrix rows name, and all verified ones of their items unless the item does
    not apply.  A parameter of another model or series is left out.

    Parameters hang on what asks for them, a method or an item with all its methods.  Of those that any key may have,
    only the first ``most`` of a method or an item can be among a key's first, so no more are joined; those of a series
    likewise, and those of a model meet the keys that chose it.
    """
    urgent = [F.col("priority").desc(), F.col("id")]
    asks = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))
    rows = selection.governed(matrix).select("model_id", F.explode(F.array(asks("method", "test_method_id"), F.when(F.col("applicability_status") != "not_applicable", asks("item", "test_item_id")))).alias("asks"))
    wanted = chosen.select(key, "model_id").join(rows.filter("asks is not null").distinct(), "model_id").select(key, "asks").distinct()
    same = ["test_method_id", N.model_code("parameter_name"), "operator", "parameter_value", N.model_code(F.coalesce("unit", F.lit("")))]

    def each_once(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, *same).orderBy(*urgent))).filter("__r = 1").drop("__r")

    rules = selection.governed(parameters).withColumnsRenamed({"model_id": "__model", "series_id": "__series"})
    columns = [c for c in rules.columns if c not in ("__model", "__series")]
    of_items = selection.governed(methods).select(F.col("id").alias("test_method_id"), asks("item", "test_item_id").alias("asks")).filter("asks is not null").distinct()

    def asked(df: DataFrame) -> DataFrame:
        own = df.filter("test_method_id is not null").withColumn("asks", asks("method", "test_method_id"))
        return own.unionByName(df.join(of_items, "test_method_id").select(*own.columns))

    def first(df: DataFrame, *keys: str) -> DataFrame:
        return selection.capped(asked(each_once(df, *keys)), ["asks", *keys], urgent, most).drop("rank")

    every, of_models = rules.filter("__model is null"), rules.filter("__model is not null")
    free, of_series = every.filter("__series is null"), every.filter("__series is not null")
    series = chosen.filter("series_id is not null").select(key, F.col("series_id").alias("__series")).distinct()
    stray = chosen.select(key).distinct().join(series.select(key).distinct(), key, "left_anti")
    take = lambda df: df.select(key, *columns)
    models = chosen.select(key, F.col("model_id").alias("__model")).distinct()
    own = wanted.join(models, key).join(asked(of_models), ["asks", "__model"])
    allowed = own.join(series.withColumnRenamed("__series", "__own"), key, "left").filter(F.col("__series").isNull() | F.col("__own").isNull() | (F.col("__own") == F.col("__series")))
    hits = take(wanted.join(first(free), "asks")).unionByName(take(allowed))
    hits = hits.unionByName(take(wanted.join(series, key).join(first(of_series, "__series"), ["asks", "__series"]))).unionByName(take(wanted.join(stray, key).join(first(of_series), "asks")))
    return selection.capped(each_once(hits, key), [key], urgent, most)


def context_text(parameters: DataFrame, key: str, most: int = 14_000) -> DataFrame:
    """(key, context): one line per parameter in order, cut at ``most`` characters with a note."""
    line = F.concat_ws("", F.lit("- 方法"), F.col("test_method_id").cast("string"), F.lit(" "), "parameter_name", F.lit(" "), "operator", "parameter_value", F.coalesce("unit", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("t"))))
    return parameters.groupBy(key).agg(selection.capped_text(F.array_join(F.transform(lines, lambda x: x["t"]), "\n"), most).alias("context"))


def condition_facts(samples: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """(key, field, value, source): facts that a sample's fields, its spec, its model and its checks state.

    Explicit numbers go before the spec; a flat shape in words or by its axes before the model's own.  Values are
    strings; conditions.reconcile_facts says where sources disagree.
    """
    number = lambda *cs: F.coalesce(*[N.strict_number(c) for c in cs])
    spec = R.primary_spec("spec")
    shape_text, model = F.concat_ws(" ", "shape", "model", "spec"), F.regexp_replace(F.upper(R.text_of("model")), r"[\s()（）_-]", "")
    flat = F.regexp_like(shape_text, F.lit("扁形|扁平")) | F.regexp_like(model, F.lit("(?:YZWB|YZB)$"))
    shape = F.when(flat, "flat").when(F.lower(F.trim("shape")).isin("round", "圆形"), "round").when(F.regexp_like(model, F.lit("(?:YQW?|YZW?|YCW?|RVVP1?|RVVPS|BL?VV)$")), "round")
    fact = lambda field, value, source: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(source).alias("source"))
    core, section = number("core_count"), number("section")
    own = F.array(
        F.when(core.isNotNull(), fact("core_count", core.cast("int"), "sample.explicit")).otherwise(fact("core_count", spec["cores"], "sample.spec")),
        F.when(section.isNotNull(), fact("nominal_section_mm2", section, "sample.explicit")).otherwise(fact("nominal_section_mm2", spec["section"], "sample.spec")),
        fact("outer_diameter_mm", number("outer_diameter_mm"), "sample.outer_diameter_mm"),
        fact("shape", shape, "sample.text"),
    )
    stated = samples.select(key, F.explode(own).alias("f")).select(key, "f.*").filter("value is not null")
    numbers = F.transform(F.regexp_extract_all(R.text_of("reported"), F.lit(r"(?<!\d)(\d+(?:\.\d+)?)(?!\d)"), F.lit(1)), lambda v: v.cast("double"))
    item = R.text_of("item")
    has = lambda *words: F.regexp_like(item, F.lit("|".join(words)))
    of_core = has("绝缘线芯") & has("外径")
    measured = F.when(of_core & (F.size(numbers) == 1), F.array(fact("insulated_core_diameter_mm", numbers[0], "checks.reported")))
    measured = measured.when(~of_core & has("外形尺寸", "短轴") & (F.size(numbers) == 2), F.array(fact("short_axis_mm", F.array_min(numbers), "checks.reported"), fact("shape", F.lit("flat"), "checks.reported")))
    measured = measured.when(~of_core & has("外径") & (F.size(numbers) == 1), F.array(fact("outer_diameter_mm", numbers[0], "checks.reported")))
    told = checks.select(key, F.explode(measured).alias("f")).select(key, "f.*")
    return stated.unionByName(told)


def profile_states(samples: DataFrame, bindings: DataFrame, rules: DataFrame, facts: DataFrame, key: str, tree: dict) -> DataFrame:
    """(key, profile_code, state): the condition of each profile bound to a sample's model, as seen in its facts; an observation only."""
    bound = samples.select(key, N.model_code("model").alias("__m")).join(selection.governed(bindings).select(N.model_code("model_code").alias("__m"), "profile_code"), "__m").drop("__m").distinct()
    known = bound.join(rules.select("profile_code"), "profile_code", "left_semi").join(facts, key, "left")
    state = conditions.compile_condition(tree, known.schema)
    return known.select(key, "profile_code", F.coalesce(state.cast("string"), F.lit("unknown")).alias("state"))


def registry_answers(answers: DataFrame, key: str, payload: str, keyword: str, exact: bool = True) -> DataFrame:
    """(key, name, raw_status, operating_status, reason): the record of a registry's JSON answer that has the name asked for.

    Records stand in the payload's ``data`` or ``items``, or are the payload.  Without an exact name the first record
    counts only if ``exact`` is off; a record without a status does not count.
    """
    record = "struct<name:string,companyName:string,regStatus:string,status:string,creditCode:string,address:string>"
    parsed = F.from_json(F.col(payload), f"data array<{record}>, items array<{record}>, name string, companyName string, regStatus string, status string, creditCode string, address string")
    alone = F.struct(*[parsed[f].alias(f) for f in ("name", "companyName", "regStatus", "status", "creditCode", "address")])
    rows = answers.select(key, keyword, F.posexplode(F.concat(F.coalesce(parsed["data"], F.array().cast(f"array<{record}>")), F.coalesce(parsed["items"], F.array().cast(f"array<{record}>")), F.array(alone))).alias("pos", "r"))
    rows = rows.select(key, keyword, "pos", N.first_value("r.name", "r.companyName").alias("name"), N.first_value("r.regStatus", "r.status").alias("raw_status")).filter("name <> ''")
    same = N.company_key("name") == N.company_key(keyword)
    ranked = rows.filter(same) if exact else rows
    best = ranked.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy((~same).cast("int"), "pos"))).filter("__r = 1")
    found = answers.select(key).join(best.select(key, "name", "raw_status"), key, "left")
    reason = F.when(F.col("name").isNull(), "name_not_found").when(F.col("raw_status") == "", "no_status")
    return found.withColumn("operating_status", F.when(reason.isNull(), N.operating_status("raw_status"))).withColumn("reason", reason)


def enrichment_totals(answers: DataFrame) -> DataFrame:
    """One row: asked, answered, failed."""
    return answers.agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("ok"), F.count_if(F.col("reason").isNotNull()).alias("failed"))


def created_once(source: DataFrame, existing: DataFrame, key: str, source_key: str) -> DataFrame:
    """Source rows that nothing has been created from yet, one per source key."""
    return source.dropDuplicates([key]).join(existing.select(F.col(source_key).alias(key)), key, "left_anti")


def owners_from_audit(reports: DataFrame, audit: DataFrame, key: str, owner: str, pattern: str) -> DataFrame:
    """Reports without an owner get the user of the one audit line that names them; two users leave it open."""
    named = audit.filter(F.col("user_id").isNotNull()).select(F.nullif(F.regexp_extract("detail", pattern, 1), F.lit("")).try_cast("long").alias(key), "user_id").filter(F.col(key).isNotNull())
    one = named.groupBy(key).agg(F.count_distinct("user_id").alias("__n"), F.min("user_id").alias("__user")).filter("__n = 1").drop("__n")
    return reports.join(one, key, "left").withColumn(owner, F.coalesce(owner, "__user")).drop("__user")


def tasks_from_audit(reports: DataFrame, audit: DataFrame, key: str, named: str, tasks: str) -> DataFrame:
    """Reports with the ``task`` that the audit lines naming them state: NULL without one, and where two tasks are named.

    ``named`` and ``tasks`` are patterns whose first group is a report's id and a task's number; a line may hold several of
    each, and a line without either, or without text, binds nothing.
    """
    found = lambda pattern: F.explode(F.array_distinct(F.regexp_extract_all("detail", F.lit(pattern), F.lit(1))))
    pairs = audit.select("detail", found(named).alias("__id")).select(F.col("__id").try_cast("long").alias(key), found(tasks).alias("__task")).filter(F.col(key).isNotNull())
    one = pairs.groupBy(key).agg(F.min("__task").alias("task"), F.max("__task").alias("__last")).filter("task = __last").drop("__last")
    return reports.join(one, key, "left")


def bound_scope(reports: DataFrame, scopes: DataFrame, on: list[str], category: str) -> DataFrame:
    """Reports with the one scope that has their keys; another category is a conflict."""
    per = scopes.groupBy(*on).agg(F.count("*").alias("__n"), F.min(category).alias("__category"), F.min("scope_id").alias("scope_id"))
    df = reports.join(per, on, "left")
    status = F.when(F.col("__n").isNull(), "unbound").when(F.col("__n") > 1, "ambiguous").when(F.col(category) != F.col("__category"), "category_conflict").otherwise("bound")
    return df.withColumn("status", status).withColumn("scope_id", F.when(status == "bound", F.col("scope_id"))).drop("__n", "__category")


def aligned_registry(batch: DataFrame, full: DataFrame, on: list[str], pages: str) -> DataFrame:
    """Batch entries that the full registry has under the same key with the same set of pages take its entry id; else NULL."""
    key = lambda df: df.withColumn("__pages", F.array_join(F.array_sort(F.array_distinct(pages)), ","))
    per = key(full).groupBy(*on, "__pages").agg(F.count("*").alias("__n"), F.min("entry_id").alias("entry_id"))
    return key(batch).join(per, [*on, "__pages"], "left").withColumn("entry_id", F.when(F.col("__n") == 1, F.col("entry_id"))).drop("__pages", "__n")


def owned_supplements(groups: DataFrame, specimens: DataFrame, on: list[str], number: str) -> DataFrame:
    """Supplement groups with the specimen that has their key and number, if one does; others become specimens of their own."""
    per = specimens.groupBy(*on, number).agg(F.count("*").alias("__n"), F.min("specimen_id").alias("specimen_id"))
    df = groups.join(per, [*on, number], "left")
    one = F.coalesce(F.col("__n") == 1, F.lit(False))
    return df.withColumn("created", ~one).withColumn("specimen_id", F.when(one, F.col("specimen_id"))).drop("__n")


def attached(observations: DataFrame, specimens: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(attached, skipped): observations with the only specimen that owns their source and page; the others with a reason."""
    per = specimens.select(*on, "specimen_id").distinct().groupBy(*on).agg(F.count("*").alias("__n"), F.min("specimen_id").alias("specimen_id"))
    df = observations.join(per, on, "left").withColumn("reason", F.when(F.col("__n").isNull(), "no_owner").when(F.col("__n") > 1, "several_owners")).drop("__n")
    return df.filter("reason is null").drop("reason"), df.filter("reason is not null").drop("specimen_id")


def checked_identity(segments: DataFrame, key: str, cover: str, header: str) -> DataFrame:
    """(key, identity, reason): what a segment's covers and table headers say, if all agree; several covers or any header that says otherwise leave none."""
    per = segments.groupBy(key).agg(F.collect_set(F.nullif(F.trim(cover), F.lit(""))).alias("c"), F.collect_set(F.nullif(F.trim(header), F.lit(""))).alias("h"))
    reason = F.when(F.size("c") > 1, "several_covers").when((F.size("c") == 1) & (F.size(F.array_except("h", "c")) > 0), "conflict").when((F.size("c") == 0) & (F.size("h") != 1), "no_identity")
    return per.select(key, F.when(reason.isNull(), F.coalesce(F.get("c", F.lit(0)), F.get("h", F.lit(0)))).alias("identity"), reason.alias("reason"))


def reference_gate(items: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """Items (on, status, result_cell, label_cell, unit_cell, raw_value) with the gate's answer.

    The three cells must exist, be different ones of one table row, and the result must be the literal value, one
    plain number.  Cells are as many as the pages' tables have, so they are merged: never sent to every task.
    """
    df = items
    for role in ("result", "label", "unit"):
        own = cells.select(*on, F.col("cell_id").alias(f"{role}_cell"), F.struct("table_no", "row_no").alias(f"__{role}_row"), F.col("text").alias(f"__{role}"))
        df = df.join(own.hint("merge"), [*on, f"{role}_cell"], "left")
    missing = F.col("__result_row").isNull() | F.col("__label_row").isNull() | F.col("__unit_row").isNull()
    collide = F.size(F.array_distinct(F.array("result_cell", "label_cell", "unit_cell"))) < 3
    across = (F.col("__result_row") != F.col("__label_row")) | (F.col("__result_row") != F.col("__unit_row"))
    plain = F.regexp_like(F.trim(F.translate("__result", "−–－$", "---")), F.lit(r"^[+-]?\d+(?:\.\d+)?$"))
    gate = (
        F.when(F.col("status") == "unknown", "unknown")
        .when(F.coalesce(F.col("status"), F.lit("")) != "candidate", "invalid_status")
        .when(missing, "missing_reference")
        .when(~F.col("__result").eqNullSafe(F.col("raw_value")), "rewritten_value")
        .when(collide, "role_collision")
        .when(across, "cross_row_or_table")
        .when(~plain, "not_single_explicit_number")
        .otherwise("reference_valid_only")
    )
    return df.withColumn("gate", gate).select(*items.columns, "gate")


def adopted(current: DataFrame, proposals: DataFrame, on: list[str]) -> DataFrame:
    """Values with the proposals that passed the gate adopted where they differ; ``prior`` keeps what stood before.

    Several different proposals for one value are none.
    """
    ok = proposals.filter("gate = 'reference_valid_only'").groupBy(*on).agg(F.count_distinct("raw_value").alias("__n"), F.min("raw_value").alias("__new")).filter("__n = 1").drop("__n")
    df = current.join(ok.hint("merge"), on, "left")
    differs = F.col("__new").isNotNull() & ~F.col("value").eqNullSafe(F.col("__new"))
    return df.withColumn("prior", F.when(differs, F.col("value"))).withColumn("value", F.coalesce("__new", "value")).drop("__new")


def supported_cells(cells: DataFrame, characters: DataFrame, on: list[str], low: float = 0.60, high: float = 0.95) -> DataFrame:
    """Cells of low confidence with whether the page's own characters in their box, in order, are the same text; cell ids count within ``on``."""
    c = characters.select(*on, "x", "y", F.col("char").alias("__char"), "hidden")
    inside = (F.col("x") >= F.col("left")) & (F.col("x") <= F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") <= F.col("bottom"))
    weak = cells.filter((F.col("confidence") >= low) & (F.col("confidence") < high))
    read = weak.join(c, on).filter(inside).groupBy(*on, "cell_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "__char"))), lambda v: v["__char"]), "").alias("__native"), F.bool_or("hidden").alias("__hidden"))
    canonical = lambda v: F.replace(F.regexp_replace(F.translate(v, "²（）：", "2():"), r"\s+|°(?=℃)", ""), F.lit("°C"), F.lit("℃"))
    same = ~F.col("__hidden") & (canonical(F.col("__native")) == canonical(F.col("text"))) & (F.col("__native") != "")
    return weak.join(read, [*on, "cell_id"], "left").withColumn("supported", F.coalesce(same, F.lit(False))).drop("__native", "__hidden")


def routed(reports: DataFrame, text: str, categories: dict[str, str], conventional: str, titles: str, bound: str | None = None) -> DataFrame:
    """Reports with ``category`` or ``error``: the first special category that a text shows, or what it is bound to.

    Special and conventional evidence together, a binding that the text contradicts, and no evidence at all stop a report.
    """
    shows = lambda p: F.regexp_like(R.text_of(text), F.lit(p))
    found = F.coalesce(*[F.when(shows(p), F.lit(c)) for c, p in categories.items()], F.lit(None).cast("string"))
    given = F.lit(None).cast("string") if bound is None else F.when(F.col(bound).isin("type_test", *categories), F.col(bound))
    chosen = F.when(given.isin(*categories), given).otherwise(found)
    error = (
        F.when(chosen.isNotNull() & shows(conventional), "mixed_scope")
        .when((given == "type_test") & found.isNotNull() & ~shows(conventional), "special_text_in_type_test")
        .when(given.isin(*categories) & found.isNotNull() & (given != found), "category_conflict")
        .when(given.isNull() & found.isNull() & ~shows(f"{conventional}|{titles}"), "no_evidence")
    )
    return reports.withColumn("error", error).withColumn("category", F.when(error.isNull(), F.coalesce(chosen, F.lit("type_test"))))


def condition_records(lines: DataFrame, keys: list[str], order: str, heading: str, patterns: dict[str, str], stop: str) -> DataFrame:
    """(keys, record): the conditions after the one heading of a group, each stated exactly once before a stop line.

    Lines between heading and stop that are no condition, or state one twice, leave no record.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.trim(R.text_of("line"))
    df = lines.withColumn("__head", F.regexp_like(text, F.lit(rf"^(?:{heading})$"))).withColumn("__stop", F.regexp_like(text, F.lit(stop)))
    df = df.withColumn("__heads", F.count_if("__head").over(w)).withColumn("__stops", F.count_if(F.col("__stop") & (F.col("__heads") > 0) & ~F.col("__head")).over(w))
    named = F.coalesce(*[F.when(F.regexp_like(text, F.lit(rf"^(?:{p})$")), F.lit(n)) for n, p in patterns.items()], F.lit(None).cast("string"))
    value = F.coalesce(*[F.nullif(F.regexp_extract(text, rf"^(?:{p})$", 1), F.lit("")) for p in patterns.values()]).try_cast("double")
    inside = df.filter("__heads > 0 and __stops = 0 and not __head").withColumn("__n", named).withColumn("__v", value).filter(text != "")
    heads = df.filter("__head").groupBy(*keys).agg(F.count("*").alias("__heads")).filter("__heads = 1").select(*keys)
    per = inside.groupBy(*keys).agg(F.bool_and(F.col("__n").isNotNull()).alias("__all"), F.count("*").alias("__rows"), F.count_distinct("__n").alias("__kinds"), *[F.max(F.when(F.col("__n") == n, F.col("__v"))).alias(n) for n in patterns])
    return per.join(heads, keys, "left_semi").filter((F.col("__all")) & (F.col("__rows") == len(patterns)) & (F.col("__kinds") == len(patterns))).select(*keys, *patterns)


def complete_row_sets(rows: DataFrame, group: list[str], stage: str, field: str, stages: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Groups whose rows have every field in every stage exactly once, and nothing else; a table that lost a row, or has one without stage or field, recovers nothing."""
    per = rows.groupBy(*group).agg(F.count("*").alias("__n"), F.count_distinct(F.struct(stage, field)).alias("__d"), F.bool_and(F.coalesce(F.col(stage).isin(*stages) & F.col(field).isin(*fields), F.lit(False))).alias("__known"))
    whole = len(stages) * len(fields)
    return per.filter((F.col("__n") == whole) & (F.col("__d") == whole) & F.col("__known")).select(*group)


def ratio_pair(values: Column, verdict: Column, low: float = 30.0, high: float = 70.0) -> Column:
    """State of a pair of shares: unresolved, consistent, or why the verdict is wrong; P needs both within the range."""
    within = F.forall(values, lambda v: (v >= low) & (v <= high))
    return (
        F.when(F.size(F.coalesce(values, F.array().cast("array<double>"))) != 2, "unresolved")
        .when(~F.coalesce(verdict.isin("P", "F"), F.lit(False)), "unresolved")
        .when(within & (verdict == "F"), "failed_within_range")
        .when(~within & (verdict == "P"), "passed_out_of_range")
        .otherwise("consistent")
    )


#: Phrases of a voltage test's outcome.
OUTCOMES = "未发生击穿|没有击穿|未击穿|不击穿|无击穿|发生击穿|已击穿|击穿"


def verdict_contradiction(result: Column, verdict: Column, merged: Column) -> Column:
    """What contradicts a row's P or N: a breakdown that passes, or none that fails; merged cells and other texts say nothing."""
    text = F.trim(R.text_of(result))
    pure = F.regexp_like(text, F.lit(rf"^(?:{OUTCOMES})(?:[\s、，,;/]+(?:{OUTCOMES}))*$"))
    broke = F.exists(F.regexp_extract_all(text, F.lit(OUTCOMES), F.lit(0)), lambda o: o.isin("击穿", "发生击穿", "已击穿"))
    mark = F.upper(F.trim(R.text_of(verdict)))
    return F.when(~pure | merged, F.lit(None).cast("string")).when((mark == "P") & broke, "击穿").when((mark == "N") & ~broke, "未击穿")


def retracted_exclusions(checks: DataFrame, required: DataFrame, on: list[str], claim: str) -> DataFrame:
    """Checks of required items whose note holds nothing but a claim that the item does not apply become manual_review.

    Any other objection in the note leaves the check alone; ``prior_verdict`` keeps what was said.
    """
    clauses = F.filter(F.split(R.text_of("note"), r"[；;。\n，,]"), lambda c: F.trim(c) != "")
    only = (F.size(clauses) > 0) & F.forall(clauses, lambda c: F.regexp_like(F.trim(c), F.lit(claim)))
    df = checks.join(required.select(*on).distinct().withColumn("__required", F.lit(True)), on, "left")
    hit = F.coalesce(F.col("__required"), F.lit(False)) & only
    return df.withColumn("prior_verdict", F.when(hit, F.col("verdict"))).withColumn("verdict", F.when(hit, "manual_review").otherwise(F.col("verdict"))).drop("__required")


def missing_required(covered: DataFrame, item: str, reference: Column) -> DataFrame:
    """Findings of required items that nothing covers: what should be there and by which reference."""
    return covered.filter("outcome = 'missing'").withColumns({"reported": F.lit("未提供"), "should_be": F.concat(F.lit("应提供"), F.col(item), F.lit("的检验结果")), "standard": reference, "severity": F.lit("must_fix"), "action_required": F.lit(True)})


def audit_listing(corrections: DataFrame, users: DataFrame, reports: DataFrame) -> DataFrame:
    """Corrections with the names of reporter and reviewer, and the report they belong to."""
    named = lambda role: users.select(F.col("user_id").alias(f"{role}_id"), F.col("name").alias(role))
    return corrections.join(named("reporter"), "reporter_id", "left").join(named("reviewer"), "reviewer_id", "left").join(reports, "report_id", "left")


def readable_checks(checks: DataFrame, key: str, order: str) -> DataFrame:
    """(key, evidence, pending): texts of a report's decided checks and of those that wait for a human, in order."""
    line = F.concat(F.col("item"), F.lit("："), R.text_of("reported"))
    of = lambda decided: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("verdict") != "manual_review") == F.lit(decided), F.struct(order, line.alias("t"))))), lambda x: x["t"]), "；")
    return checks.groupBy(key).agg(of(True).alias("evidence"), of(False).alias("pending"))


def supplier_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Material groups over documents: items, filed ones, brands, whether any part needs a review; filed above all needs one."""
    per = rows.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("filed").alias("filed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("brands")))).alias("brands"), F.bool_or("needs_review").alias("__r"))
    return per.withColumn("needs_review", F.col("__r") | (F.col("filed") > F.col("total"))).drop("__r")


def value_domain(groups: DataFrame, keys: list[str], values: str, low: str, high: str) -> DataFrame:
    """Per key: least and most of listed values and of bounds, and whether only listed values occur."""
    listed = F.size(F.coalesce(values, F.array().cast("array<double>"))) > 0
    return groups.groupBy(*keys).agg(F.min(F.least(F.array_min(values), F.col(low))).alias("least"), F.max(F.greatest(F.array_max(values), F.col(high))).alias("most"), F.bool_and(listed).alias("exact_only"))

"""Requirements of sample plans as data: which apply, what tasks they mean, which candidates do them, at what cost.

A requirement is a row; its kind says how the scoped candidates become targets.  A target's fields that are NULL ask
for nothing, so one predicate matches all kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsheaf.operators import sampling

CORNERS = ("exact_corner_pair", "corner_pair", "compatible_corner_pair")
#: Fields of a target; candidates have columns of the same names.
FIELDS = ("section", "cores", "shape", "model_ref", "series", "temperature", "subunit", "screening_group", "sheath")
_TYPES = {"section": "double", "cores": "int", "sheath": "boolean"}
#: The shapes and colours that plans name.
SHAPE_TEXT, COLOR_TEXT = {"round": "圆形", "flat": "扁形", "twisted": "绞合", "parallel": "平行", "grouped": "成组"}, {"white": "白色", "black": "黑色"}


def application_facts(models: DataFrame, key: str) -> DataFrame:
    """Sets of what an application's models are: refs, subunits, series, temperatures, other values, and flags."""
    sets = {"refs": "model_ref", "subunits": "subunit", "all_series": "series", "temperatures": "temperature"}
    other = F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array("conductor", "flexibility", "shape")))))
    flags = [F.bool_or(~F.coalesce("sheath", F.lit(False))).alias("unsheathed"), F.bool_or(F.coalesce("sheath", F.lit(False))).alias("sheathed"), F.bool_or(F.col("screening_group").isNotNull()).alias("screened")]
    return models.groupBy(key, "unit").agg(*[F.collect_set(c).alias(n) for n, c in sets.items()], other.alias("values"), *flags)


def applies(when: str = "when") -> Column:
    """Whether a requirement's conditions (struct) hold for an application's facts; a missing condition holds."""
    w = F.col(when)
    one = lambda name, has: w[name].isNull() | has(w[name])
    flag = lambda name, fact: ~F.coalesce(w[name], F.lit(False)) | F.col(fact)
    within = lambda facts: lambda v: F.array_contains(facts, v)
    return (
        one("model_applied", within("refs"))
        & one("all_models", lambda v: F.size(F.array_except(v, F.col("refs"))) == 0)
        & one("any_models", lambda v: F.arrays_overlap(v, F.col("refs")))
        & one("subunit_applied", within("subunits"))
        & one("subunits_applied", lambda v: F.size(F.array_except(v, F.col("subunits"))) == 0)
        & one("none_subunits_applied", lambda v: ~F.arrays_overlap(v, F.col("subunits")))
        & one("unit_applied", lambda v: F.lpad(v, 2, "0") == F.lpad("unit", 2, "0"))
        & one("any_standard_family", within("all_series"))
        & one("any_temperature_class", within("temperatures"))
        & flag("any_unsheathed_model", "unsheathed")
        & flag("any_sheathed_model", "sheathed")
        & flag("any_screened_model", "screened")
        & flag("series_contains_sheathed_model", "sheathed")
        & one("series_applied", lambda v: F.arrays_overlap(v, F.col("all_series")))
        & one("contains_both", lambda v: F.size(F.array_except(v, F.col("values"))) == 0)
    )


def applicable(requirements: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """Open requirements of an application's unit whose conditions its models meet: an equi-join on the unit, then a filter."""
    open_ones = requirements.filter(F.col("status").isin("review_draft", "approved", "enabled"))
    return application_facts(models, key).join(open_ones, "unit").filter(applies()).select(key, *[c for c in requirements.columns if c not in ("when", "status")])


def _target(suffix: Column, **fields: Column) -> Column:
    columns = [(fields[f] if f in fields else F.lit(None)).cast(_TYPES.get(f, "string")).alias(f) for f in FIELDS]
    return F.struct(suffix.alias("suffix"), *columns)


def tasks(requirements: DataFrame, cands: DataFrame, key: str) -> DataFrame:
    """(key, task, id, kind, fields): the targets of requirements (key, id, kind, models, subunit, sheathed, values, section, cores, hard).

    Scope: the models that a requirement names, or its subunit, or all; ``sheathed`` limits it further.  Requirements
    without a candidate in scope have no tasks.
    """
    c = cands.select(key, *[F.col(f).alias(f"c_{f}") for f in FIELDS])
    in_scope = (F.size(F.coalesce("models", F.array().cast("array<string>"))) == 0) | F.array_contains("models", F.col("c_model_ref"))
    in_scope = in_scope & (F.col("subunit").isNull() | (F.size(F.coalesce("models", F.array().cast("array<string>"))) > 0) | (F.col("subunit") == F.col("c_subunit")))
    in_scope = in_scope & (F.col("sheathed").isNull() | (F.col("sheathed") == F.coalesce("c_sheath", F.lit(False))))
    both = F.col("c_section").isNotNull() & F.col("c_cores").isNotNull()
    corner = lambda f, cores, section: f(F.when(both, F.struct(cores, section)))
    scoped = requirements.join(c, key).filter(in_scope)
    keep = ["id", "kind", "models", "values", "section", "cores", "hard", "subunit"]
    per = scoped.groupBy(key, *keep).agg(
        F.min("c_section").alias("least"),
        F.max("c_section").alias("most"),
        F.min("c_cores").alias("fewest"),
        F.max("c_cores").alias("many"),
        corner(F.max, F.col("c_cores").alias("n"), (-F.col("c_section")).alias("s")).alias("small"),
        corner(F.min, F.col("c_cores").alias("n"), (-F.col("c_section")).alias("s")).alias("large"),
        *[F.array_sort(F.collect_set(F.when(when, F.col(c)))).alias(n) for n, c, when in (("refs", "c_model_ref", F.lit(True)), ("all_series", "c_series", F.lit(True)), ("sheathed_series", "c_series", F.col("c_sheath")), ("groups", "c_screening_group", F.lit(True)))],
    )
    text, kind = F.lit, F.col("kind")
    each = lambda values, field: F.transform(values, lambda v: _target(v, **{field: v}))
    wanted = lambda text_value, low, high: F.when(text_value == "actual_min", low).when(text_value == "actual_max", high).otherwise(text_value.try_cast("double"))
    only = F.get("models", text(0))
    exact = F.when(kind == "exact_corner_pair", only)
    ends = F.array(_target(text("min"), section=F.col("least")), _target(text("max"), section=F.col("most")))
    of_model = F.array(_target(text("min"), section=F.col("least"), model_ref=only), _target(text("max"), section=F.col("most"), model_ref=only))
    corners = F.array(_target(text("max-cores-min-section"), section=-F.col("small.s"), cores=F.col("small.n"), model_ref=exact), _target(text("min-cores-max-section"), section=-F.col("large.s"), cores=F.col("large.n"), model_ref=exact))
    sample = _target(only, model_ref=only, section=wanted(F.col("section"), F.col("least"), F.col("most")), cores=wanted(F.col("cores"), F.col("fewest"), F.col("many")))
    targets = (
        F.when(kind == "per_model_section_endpoints", of_model)
        .when(kind.isin(*CORNERS), corners)
        .when(kind.isin("unit_section_endpoints", "subunit_section_endpoints"), ends)
        .when(kind == "attribute_presence", each(F.col("values"), "series"))
        .when(kind == "temperature_presence", each(F.col("values"), "temperature"))
        .when(kind == "subunit_representation", F.array(_target(text("representative"), subunit=F.col("subunit"))))
        .when(kind.isin("model_presence", "model_set_presence"), each(F.col("refs"), "model_ref"))
        .when(kind == "exact_model_sample", F.array(sample))
        .when(kind == "shape_pair", each(F.col("values"), "shape"))
        .when(kind == "series_presence", each(F.col("all_series"), "series"))
        .when(kind == "series_sheathed_presence", F.transform("sheathed_series", lambda v: _target(v, series=v, sheath=text(True))))
        .when(kind == "screening_group_presence", each(F.col("groups"), "screening_group"))
        .when(kind == "unsheathed_representation", F.array(_target(text("unsheathed"), sheath=text(False))))
        .when(kind.isin("selection_preference", "temperature_distribution") & F.col("hard"), F.transform("values", lambda v: _target(F.concat(F.col("subunit"), text("-"), v), subunit=F.col("subunit"), temperature=v)))
    )
    rows = per.select(key, "id", "kind", F.explode(targets).alias("t")).select(key, "id", "kind", "t.*")
    return rows.select(key, F.concat_ws(":", "id", "suffix").alias("task"), "id", "kind", *FIELDS).dropDuplicates([key, "task"])


def pairs(task_rows: DataFrame, cands: DataFrame, key: str, sequence: DataFrame) -> DataFrame:
    """(key, task, candidate, cost): candidates that do a task, within the application.

    Sections are carried by neighbours in the standard sequence up to 10 (sampling.carries), but not for tasks that name a
    model; corners of another kind than exact let cores be carried by neighbours too.
    """
    ranks = lambda value, rank: sequence.select(F.col("section").alias(value), F.col("rank").alias(rank))
    t = task_rows.join(ranks("section", "__t"), "section", "left")
    c = cands.select(key, "candidate", *[F.col(f).alias(f"c_{f}") for f in FIELDS]).join(ranks("c_section", "__c"), "c_section", "left")
    own = lambda f: F.col(f).isNull() | (F.coalesce(F.col(f"c_{f}"), F.lit(False)) if f == "sheath" else F.col(f"c_{f}")).eqNullSafe(F.col(f))
    carried = F.col("model_ref").isNull() & F.coalesce(sampling.carries(F.col("c_section"), F.col("section"), F.col("__c"), F.col("__t")), F.lit(False))
    fits = F.col("section").isNull() | own("section") | carried
    near_cores = own("cores") | (F.col("kind").isin("corner_pair", "compatible_corner_pair") & F.coalesce(F.abs(F.col("c_cores") - F.col("cores")) == 1, F.lit(False)))
    for f in FIELDS[2:]:
        fits = fits & own(f)
    return t.join(c, key).filter(fits & near_cores).select(key, "task", "candidate", task_cost().alias("cost"))


def task_cost() -> Column:
    """What it costs that a candidate differs from a task's target: corners weigh double."""
    corner = F.col("kind").isin(*CORNERS)
    differs = lambda f: F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"c_{f}"))
    return F.when(differs("section"), F.when(corner, 4).otherwise(2)).otherwise(0) + F.when(differs("cores"), F.when(corner, 2).otherwise(1)).otherwise(0)


def improved(plan: list[int], costs: dict[int, dict[str, float]], tasks: list[str]) -> list[int]:
    """A plan in which no single swap covers all tasks at less cost; a task costs what its best sample costs.

    ``costs`` has, for every candidate, the tasks that it does and at what cost.
    """

    def total(chosen: list[int]) -> float:
        return sum(min((costs[c][t] for c in chosen if t in costs[c]), default=float("inf")) for t in tasks)

    plan, best = sorted(plan), total(plan)
    while True:
        swaps = [sorted([*plan[:k], other, *plan[k + 1 :]]) for k in range(len(plan)) for other in sorted(costs) if other not in plan]
        better = min(((total(p), p) for p in swaps), default=(best, plan))
        if better[0] >= best:
            return plan
        best, plan = better


def with_color_pair(samples: DataFrame, needing: DataFrame, key: str, order: str) -> DataFrame:
    """Samples with colours: where a pair is needed the first is white, the second black; a single one is sent twice."""
    w = Window.partitionBy(key)
    rows = samples.join(needing.select(key).distinct().withColumn("__pair", F.lit(True)), key, "left").withColumn("__n", F.row_number().over(w.orderBy(order))).withColumn("__all", F.count("*").over(w))
    twice = F.col("__pair") & (F.col("__all") == 1)
    rows = rows.withColumn("__n", F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array("__n"))))
    color = F.when(F.col("__pair") & (F.col("__n") == 1), "white").when(F.col("__pair") & (F.col("__n") == 2), "black")
    return rows.withColumn("color", color).drop("__pair", "__all", "__n")


def relaxed(assigned: DataFrame, task_rows: DataFrame, key: str) -> DataFrame:
    """(key, candidate, any_spec): a sample none of whose tasks asks for a section, cores or a shape may have any specification."""
    bound = F.col("section").isNotNull() | F.col("cores").isNotNull() | F.col("shape").isNotNull()
    rows = assigned.select(key, "task", "candidate").join(task_rows.select(key, "task", bound.alias("__bound")), [key, "task"])
    return rows.groupBy(key, "candidate").agg((~F.bool_or("__bound")).alias("any_spec"))


def spec_text(section: Column, cores: Column, shape: Column, color: Column, any_spec: Column) -> Column:
    """What a plan writes for a sample: cores × section with shape and colour, or that any specification will do."""
    look = lambda c, words: F.coalesce(*[F.when(c == k, v) for k, v in words.items()], F.lit(None).cast("string"))
    number = F.regexp_replace(section.cast("decimal(18,3)").cast("string"), r"\.?0+$", "")
    size = F.when(any_spec, "任意规格一件").when(section.isNull(), F.concat(cores.cast("string"), F.lit("芯"))).when(cores.isNull(), F.concat(number, F.lit("mm²"))).otherwise(F.concat(cores.cast("string"), F.lit("×"), number, F.lit("mm²")))
    return F.concat_ws(" ", size, look(shape, SHAPE_TEXT), look(color, COLOR_TEXT))


def copy_text(samples: DataFrame, key: str, position: str, line: Column) -> DataFrame:
    """(key, text): a plan's samples as numbered lines."""
    rows = F.array_sort(F.collect_list(F.struct(position, line.alias("t"))))
    return samples.groupBy(key).agg(F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n").alias("text"))


def material_groups(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, category, total, filed, brands, needs_review) of descriptions ``类别：供应商√(编号)、供应商；...``.

    A ticked supplier with a number is filed; a tick without a number, or a number without a tick, needs a review.
    """
    section = texts.select(key, F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([^：:；;\n]+[：:][^；;\n]*)"), F.lit(1))).alias("s"))
    named = section.select(key, F.trim(F.regexp_extract("s", r"^([^：:]+)[：:]", 1)).alias("category"), F.explode(F.split(F.regexp_extract("s", r"^[^：:]+[：:](.*)$", 1), "[、,，]")).alias("e")).filter(F.trim("e") != "")
    ticked, number = F.regexp_like("e", F.lit("[√✓]")), F.regexp_extract("e", r"[(（]([A-Za-z0-9-]{4,})[)）]", 1)
    rows = named.select(key, "category", F.trim(F.regexp_replace("e", r"[√✓]|[(（].*?[)）]", "")).alias("brand"), (ticked & (number != "")).alias("filed"), (ticked != (number != "")).alias("odd"))
    return rows.groupBy(key, "category").agg(F.count("*").alias("total"), F.count_if("filed").alias("filed"), F.array_sort(F.collect_set("brand")).alias("brands"), F.bool_or("odd").alias("needs_review"))

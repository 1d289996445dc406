"""Rules as data: one operator applies a pack to checks, one extracts measurements by templates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsheaf.operators.conditions import compile_condition


@dataclass(frozen=True)
class PackRule:
    """A rule of a stage: where ``match`` (SQL) holds and the condition is true, the action applies.

    Actions: set_verdict (to ``value``), suppress, annotate (with ``value``), add_finding (text ``value``).
    An unknown condition never acts, but leaves ``manual_review`` where ``on_unknown`` says so.
    """

    code: str
    stage: int
    match: str
    action: str
    value: str = ""
    condition: dict = field(default_factory=dict)
    on_unknown: str | None = None


def apply_rule_pack(checks: DataFrame, rules: list[PackRule], verdict: str = "verdict") -> tuple[DataFrame, DataFrame]:
    """(checks, findings) after all stages in order.  Rules of a stage see its start; the first that matches acts.

    Everything is one projection per stage: rules are compiled, nothing is joined or shuffled.
    """
    df = checks.withColumns({"applied": F.expr("cast(array() as array<string>)"), "notes": F.expr("cast(array() as array<string>)"), "findings": F.expr("cast(array() as array<string>)"), "suppressed": F.lit(False)})
    for stage in sorted({r.stage for r in rules}):
        new_verdict, applied, notes, findings, suppressed = F.col(verdict), F.col("applied"), F.col("notes"), F.col("findings"), F.col("suppressed")
        taken: Column = F.col("suppressed")
        for r in (r for r in rules if r.stage == stage):
            state = compile_condition(r.condition, checks.schema) if r.condition else F.lit(True)
            hit = F.coalesce(F.expr(r.match), F.lit(False)) & ~taken
            acts = hit & F.coalesce(state, F.lit(False))
            unknown = hit & state.isNull() if r.on_unknown else F.lit(False)
            applied = F.when(acts, F.array_append(applied, F.lit(r.code))).otherwise(applied)
            if r.action == "set_verdict":
                new_verdict = F.when(acts, F.lit(r.value)).when(unknown, F.lit(r.on_unknown)).otherwise(new_verdict)
            elif r.action == "suppress":
                suppressed = suppressed | acts
            elif r.action == "annotate":
                notes = F.when(acts, F.array_append(notes, F.lit(r.value))).otherwise(notes)
            else:
                findings = F.when(acts, F.array_append(findings, F.lit(r.value))).otherwise(findings)
            taken = taken | acts | unknown
        df = df.withColumns({verdict: new_verdict, "applied": applied, "notes": notes, "findings": findings, "suppressed": suppressed})
    found = df.select(*[c for c in checks.columns], F.explode("findings").alias("finding"))
    return df.filter("not suppressed").drop("findings", "suppressed"), found


@dataclass(frozen=True)
class Template:
    """What a measurement looks like in a line: label, then optionally a limit, then values; all regular expressions."""

    item: str
    label: str
    value: str = r"-?\d+(?:\.\d+)?"
    limit: str = r"(?:≥|>=|≤|<=)\s*\d+(?:\.\d+)?"
    unit: str = ""


#: Unit -> (what it measures in, factor).  A value converts between units of one base only.
UNITS = {
    "mm": ("mm", 1.0), "cm": ("mm", 10.0), "m": ("mm", 1000.0), "µm": ("mm", 0.001), "μm": ("mm", 0.001),
    "N/mm2": ("N/mm2", 1.0), "N/mm²": ("N/mm2", 1.0), "MPa": ("N/mm2", 1.0), "kPa": ("N/mm2", 0.001),
    "mg/cm2": ("mg/cm2", 1.0), "mg/cm²": ("mg/cm2", 1.0), "g/m2": ("mg/cm2", 0.1), "g/m²": ("mg/cm2", 0.1),
    "%": ("%", 1.0), "‰": ("%", 0.1), "N": ("N", 1.0), "kN": ("N", 1000.0),
    "Ω/km": ("Ω/km", 1.0), "mΩ/m": ("Ω/km", 1.0), "Ω/m": ("Ω/km", 1000.0), "MΩ·km": ("MΩ·km", 1.0), "GΩ·km": ("MΩ·km", 1000.0),
}
#: Anything that stands behind a number like a unit, known or not.
_UNIT = r"[A-Za-zµμΩ℃°%‰](?:[A-Za-zµμΩ℃°%‰/·²³]|(?<=m)[23])*"
_NOT_INSIDE = r"(?<![A-Za-z0-9.²³/])"


def _factor(unit: Column, wanted: str) -> Column:
    """What a value in ``unit`` is multiplied by to be in ``wanted``: 1 without a unit, null for a unit of something else."""
    base, own = UNITS.get(wanted, (wanted, 1.0))
    factors = {u: f / own for u, (b, f) in UNITS.items() if b == base} | {wanted: 1.0}
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    return F.when(unit == "", F.lit(1.0)).otherwise(F.try_element_at(table, unit))


def _quantities(text: Column, number: str, wanted: str) -> Column:
    """The numbers of a text with their units read, in the wanted unit; null where a unit does not convert."""
    pattern = F.lit(rf"{_NOT_INSIDE}({number})(?:[ \t]*({_UNIT}))?")
    return F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda v, u: v.try_cast("double") * _factor(u, wanted))


def extract_measurements(lines: DataFrame, keys: list[str], text: str, templates: list[Template]) -> DataFrame:
    """(keys, item, unit, limit_op, limit, values, status) of every line that has a template's label.

    Units behind numbers are read: values and the limit are in the template's unit, which a number without one is taken to be in.
    ``unresolved`` where there is no value, a unit does not convert, or there are two limits: ambiguity is never resolved by position.
    """
    found = []
    for t in templates:
        limited = rf"{t.limit}(?:[ \t]*{_UNIT})?"

        def parted(rest: Column) -> Column:
            return F.struct(F.regexp_extract_all(rest, F.lit(f"({limited})"), F.lit(1)).alias("limits"), F.regexp_replace(rest, limited, " ").alias("plain"))

        def read(r: Column) -> Column:
            limit = F.get(r["limits"], F.lit(0))
            return F.struct((F.size(r["limits"]) == 1).alias("one"), (F.size(r["limits"]) <= 1).alias("few"), F.translate(F.regexp_extract(limit, r"^[^\d]+", 0), " ", "").alias("op"), F.regexp_replace(limit, r"^[^\d-]+", "").alias("amount"), _quantities(r["plain"], t.value, t.unit).alias("values"))

        def bounded(r: Column) -> Column:
            return F.struct(r["one"].alias("one"), r["few"].alias("few"), r["op"].alias("op"), F.get(_quantities(r["amount"], r"\d+(?:\.\d+)?", t.unit), F.lit(0)).alias("bound"), r["values"].alias("values"))

        def measured(r: Column) -> Column:
            sure = (F.size(r["values"]) > 0) & ~F.exists(r["values"], lambda v: v.isNull()) & r["few"] & (~r["one"] | r["bound"].isNotNull())
            return F.struct(
                F.lit(t.item).alias("item"),
                F.lit(t.unit).alias("unit"),
                F.when(r["one"], r["op"]).alias("limit_op"),
                F.when(r["one"], r["bound"]).alias("limit"),
                r["values"].alias("values"),
                F.when(sure, "complete").otherwise("unresolved").alias("status"),
            )

        # Each step runs over the one result of the step before; columns that name a result twice would work it out twice.
        steps = F.array(F.regexp_extract(text, rf"(?:{t.label})\s*[:：]?\s*(.*)$", 1))
        for step in (parted, read, bounded, measured):
            steps = F.transform(steps, step)
        found.append(F.when(F.regexp_like(text, F.lit(t.label)), F.get(steps, F.lit(0))))
    return lines.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("m")).select(*keys, "m.*")

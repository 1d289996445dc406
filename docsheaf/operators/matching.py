"""Binding rows to master data.  A match counts only if it is unique; none and several are unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_or_unresolved(rows: DataFrame, master: DataFrame, on: list[str], take: list[str]) -> DataFrame:
    """Rows with the master's columns where exactly one master row has the key, and how many have it."""
    per = master.groupBy(*on).agg(F.count("*").alias("candidates"), *[F.min(c).alias(c) for c in take])
    one = [F.when(F.col("candidates") == 1, F.col(c)).alias(c) for c in take]
    return rows.join(per.select(*on, "candidates", *one), on, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def with_fallback(rows: DataFrame, id_col: str, master: DataFrame, exact: list[str], alias: list[str], take: str) -> DataFrame:
    """Binds by the exact key, and what that leaves unresolved by the alias key; both must be unique.

    ``bound_by`` says how: exact, alias, or NULL.
    """
    first = unique_or_unresolved(rows, master, exact, [take])
    second = unique_or_unresolved(rows.select(id_col, *alias).distinct(), master, alias, [take]).select(id_col, F.col(take).alias("__alias"))
    df = first.join(second, id_col, "left")
    value = F.coalesce(take, F.when(F.col("candidates") == 0, F.col("__alias")))
    how = F.when(F.col(take).isNotNull(), "exact").when((F.col("candidates") == 0) & F.col("__alias").isNotNull(), "alias")
    return df.withColumns({"bound_by": how, take: value}).drop("__alias", "candidates")


#: Names up to which texts look for their words before they are exploded; beyond, the join alone finds them.
MANY_NAMES = 10_000
_NOT_WORD = r"[^\p{L}\p{N}]+"


def contained_names(texts: DataFrame, id_col: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(id, name columns) of names that occur in a text as whole tokens.

    A text becomes its distinct phrases, as long as the longest name, which meet the names in an equi-join; it is read
    once and never joined back.  If the names are few, only phrases that are names leave the row.
    """
    words = lambda c: F.filter(F.split(F.lower(c), _NOT_WORD), lambda w: w != "")
    keyed = names.withColumn("__phrase", F.array_join(words(F.col(name)), " ")).filter("__phrase <> ''")
    known = [r[0] for r in keyed.select("__phrase").distinct().limit(MANY_NAMES + 1).collect()]
    few = len(known) <= MANY_NAMES
    most = max([k.count(" ") + 1 for k in known], default=1) if few else keyed.agg(F.max(F.size(F.split("__phrase", " ")))).first()[0]
    tokens = texts.select(id_col, words(F.coalesce(F.col(text), F.lit(""))).alias("__w"))

    def of_length(n: int) -> Column:
        if n == 1:
            return F.col("__w")
        places = F.when(F.size("__w") >= n, F.sequence(F.lit(1), F.size("__w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        firsts = sorted({k.split(" ")[0] for k in known if k.count(" ") == n - 1})
        places = F.filter(places, lambda i: F.get("__w", i - 1).isin(firsts)) if few else places
        return F.transform(places, lambda i: F.array_join(F.slice("__w", i, F.lit(n)), " "))

    phrases = [of_length(n) for n in range(1, most + 1) if not few or any(k.count(" ") == n - 1 for k in known)] or [F.array().cast("array<string>")]
    found = F.array_distinct(F.concat(*phrases))
    if few:
        found = F.array_intersect(found, F.array(*map(F.lit, known)).cast("array<string>"))
    return tokens.select(id_col, F.explode(found).alias("__phrase")).join(keyed, "__phrase").drop("__phrase")


def longest(hits: DataFrame, keys: list[str], name: str, *tie: Column) -> DataFrame:
    """The hit with the longest name of each key."""
    w = Window.partitionBy(*keys).orderBy(F.length(name).desc(), *tie, F.col(name))
    return hits.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def longest_unique(hits: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The longest hit of each key if no other is as long; keys without are absent."""
    per = hits.groupBy(*keys).agg(F.max(F.length(name)).alias("__longest"))
    top = hits.join(per, keys).filter(F.length(name) == F.col("__longest"))
    return top.groupBy(*keys).agg(F.count_distinct(name).alias("__n"), F.min(name).alias(name)).filter("__n = 1").drop("__n")


def score_band(scored: DataFrame, keys: list[str], score: str, band: float, most: int, tie: str) -> DataFrame:
    """Rows within ``band`` of the best score of their key, the best ``most`` of them, ranked."""
    w = Window.partitionBy(*keys)
    ranked = scored.withColumn("__best", F.max(score).over(w)).filter(F.col(score) >= F.col("__best") - band)
    return ranked.withColumn("rank", F.row_number().over(w.orderBy(F.col(score).desc(), F.col(tie)))).filter(F.col("rank") <= most).drop("__best")


def step_lookup(rows: DataFrame, value: str, steps: list[tuple[float, float]], beyond: float | None, name: str) -> DataFrame:
    """The result of the first step whose upper bound is not below the value; a short table compiled to one CASE."""
    out = F.lit(beyond)
    for upper, result in sorted(steps, reverse=True):
        out = F.when(F.col(value) <= upper, F.lit(result)).otherwise(out)
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), out))


def compatible(value: Column, low: Column, high: Column) -> Column:
    """Inside the bounds; an open bound or an unknown value does not reject."""
    return F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))


def range_join(rows: DataFrame, rules: DataFrame, on: Column, ranges: list[tuple[str, str, str]]) -> DataFrame:
    """Rows with every rule that is compatible in all (value, low, high) ranges; ``on`` is an equality that Spark can shuffle by."""
    condition = on
    for value, low, high in ranges:
        condition = condition & compatible(F.col(value), F.col(low), F.col(high))
    return rows.join(rules, condition)


def reconcile(source: DataFrame, returned: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join with a status: matched, created_from_source (only in source), unmatched (only returned)."""
    a, b = source.withColumn("__s", F.lit(True)), returned.withColumn("__r", F.lit(True))
    status = F.when(F.col("__s") & F.col("__r"), "matched").when(F.col("__s"), "created_from_source").otherwise("unmatched")
    return a.join(b, on, "full").withColumn("status", status).drop("__s", "__r")


def prefix_compatible(new: DataFrame, known: DataFrame, name: str, known_name: str, block: int = 6, gap: int = 8) -> DataFrame:
    """Pairs of names of which one is a prefix of the other, at least ``block`` long and at most ``gap`` apart.

    The longer name meets the shorter one by its own prefixes, one for each length that is allowed: an equi-join on
    whole names, so names that only begin alike never meet.  Null and shorter names have no pair.
    """
    key = "__prefix"
    enough = lambda c: F.length(c) >= block
    a, b = new.filter(enough(name)), known.filter(enough(known_name))

    def cut_to(c: str, longest: Column) -> Column:
        lengths = F.filter(F.sequence(F.greatest(F.lit(block), F.length(c) - gap), F.length(c)), lambda k: k <= longest)
        return F.explode(F.transform(lengths, lambda k: F.substr(F.col(c), F.lit(1), k))).alias(key)

    shorter_known = a.select("*", cut_to(name, F.length(name))).join(b.withColumn(key, F.col(known_name)), key).drop(key)
    longer_known = a.withColumn(key, F.col(name)).join(b.select("*", cut_to(known_name, F.length(known_name) - 1)), key).drop(key)
    return shorter_known.unionAll(longer_known)


def ngrams(c: Column, n: int = 4) -> Column:
    """Distinct n-grams of a text: two labels share one if and only if their longest common substring is n or more."""
    steps = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(steps, lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.expr("cast(array() as array<string>)"))


def same_label(a: Column, b: Column, n: int = 4) -> Column:
    return F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(ngrams(a, n), ngrams(b, n))


def label_matches(labels: DataFrame, within: list[str], id_col: str, label: str, n: int = 4) -> DataFrame:
    """Pairs of labels of one group that match: n-grams meet in an equi-join, short labels by containment."""
    grams = labels.select(*within, F.col(id_col).alias("id"), F.explode(ngrams(F.col(label), n)).alias("gram"))
    left, right = grams.select(*within, "gram", F.col("id").alias("a")), grams.select(*within, "gram", F.col("id").alias("b"))
    pairs = left.join(right, [*within, "gram"]).filter("a < b").select(*within, "a", "b")
    short = labels.filter(F.length(label) < n)
    s = short.select(*within, F.col(id_col).alias("x"), F.col(label).alias("sx"))
    o = labels.select(*within, F.col(id_col).alias("y"), F.col(label).alias("sy"))
    contained = s.join(o, within).filter((F.col("x") != F.col("y")) & (F.contains("sy", F.col("sx")) | F.contains("sx", F.col("sy")))).select(*within, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.unionByName(contained).distinct()


def band_matches(gaps: DataFrame, boxes: DataFrame, on: list[str], coordinates: list[str], tolerance: float) -> DataFrame:
    """Gaps with the one box of the same key whose coordinates all lie within the tolerance; several are none."""
    b = boxes.select(*on, *[F.col(c).alias(f"__{c}") for c in coordinates], F.col("text").alias("__text"))
    near = [F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance for c in coordinates]
    hits = gaps.join(b, on)
    for n in near:
        hits = hits.filter(n)
    one = hits.groupBy("id").agg(F.count("*").alias("n"), F.min("__text").alias("found")).filter("n = 1").drop("n")
    return gaps.join(one, "id", "left")


def supplemented(primary: DataFrame, supplement: DataFrame, doc: str, page: str, identifier: str) -> DataFrame:
    """(doc, page, text, conflict): two layers of pages; a document is in conflict if its page sets or identifiers differ."""
    a = primary.select(doc, page, F.col("text").alias("text"), F.col(identifier).alias("__ia"))
    b = supplement.select(doc, page, F.col("text").alias("__more"), F.col(identifier).alias("__ib"))
    both = a.join(b, [doc, page], "full")
    bad = F.col("text").isNull() | F.col("__more").isNull() | F.coalesce(F.col("__ia") != F.col("__ib"), F.lit(False))
    rows = both.filter(F.col(doc).isNotNull()).select(doc, page, F.concat_ws("\n", "text", "__more").alias("text"), bad.alias("__bad"))
    return rows.select(doc, page, "text", F.bool_or("__bad").over(Window.partitionBy(doc)).alias("conflict"))


def witnessed(primary: DataFrame, witness: DataFrame, on: list[str], value: str) -> DataFrame:
    """A second source overrides the first where it differs; the prior value is kept beside it."""
    w = witness.select(*on, F.col(value).alias("__w"))
    differs = F.col("__w").isNotNull() & ~F.col("__w").eqNullSafe(F.col(value))
    return primary.join(w, on, "left").withColumns({"prior": F.when(differs, F.col(value)), value: F.coalesce("__w", value)}).drop("__w")


def agreed_readings(attempts: DataFrame, keys: list[str], primary: str, reading: str, confidence: str, scale: str, scales: tuple[int, ...] = (3, 4), least: float = 0.95) -> DataFrame:
    """Keys whose two attempts, one per scale, are sure enough and read what the first source has."""
    per = attempts.groupBy(*keys, primary).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(scale)).alias("s"), F.min(confidence).alias("c"), F.count_distinct(reading).alias("d"), F.min(reading).alias(reading))
    return per.withColumn("accepted", (F.col("n") == len(scales)) & (F.col("s") == F.array(*map(F.lit, scales))) & (F.col("c") >= least) & (F.col("d") == 1) & F.col(primary).eqNullSafe(F.col(reading))).select(*keys, primary, reading, "accepted")


def cited(rows: DataFrame, catalogue: DataFrame, exact: list[str], concept: str, take: str) -> DataFrame:
    """Citations checked by their whole key, else corrected by a concept that one entry has, else blocked."""
    whole = catalogue.select(*exact, F.col(take).alias("__exact")).dropDuplicates(exact)
    by_concept = catalogue.groupBy(concept).agg(F.count("*").alias("__n"), F.min(take).alias("__one")).filter("__n = 1").drop("__n")
    df = rows.join(whole, exact, "left").join(by_concept, concept, "left")
    how = F.when(F.col("__exact").isNotNull(), "valid").when(F.col("__one").isNotNull(), "corrected").otherwise("blocked")
    return df.withColumns({"citation": how, take: F.coalesce("__exact", "__one")}).drop("__exact", "__one")

"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document.  The ledger stores what was measured and one bit
per failed rule.  Policies are versioned masks over those bits, so applying another version, or
asking what a rule alone costs (an ablation), is integer arithmetic on the ledger and never touches
a text again.

Defined cases: a null text counts as empty; an empty text has no words and fails ``few_words``;
repeated rows each get their own ledger row; an empty table gives an empty ledger; columns of the
input are kept, working columns avoid their names, and an input column that is named like one of the
ledger's gets underscores in front (the pipeline stage gives it its name back).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.llm.shared import SPACES, free_name, read_documents, whole_text

#: Words in one window of the repetition measure.
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
LEDGER = (*MEASURES, "fail_bits", "kept")


@dataclass(frozen=True)
class Rule:
    """One rule: a bit of the ledger and the SQL condition on the measures under which it fails."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


#: Bits are never reused; a changed rule gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
)
BASE = RULES[0].mask | RULES[1].mask
#: Version -> mask of the rules that reject.
POLICIES = {
    "base": BASE,
    "2026-1": BASE | RULES[2].mask | RULES[3].mask | RULES[4].mask | RULES[5].mask,
}
CURRENT = "2026-1"


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that are named like the ledger's renamed, and the new name of every column."""
    names: dict[str, str] = {}
    for c in docs.columns:
        new = free_name(docs, f"_{c}") if c.lower() in LEDGER else c
        docs, names[c] = docs.withColumnRenamed(c, new), new
    return docs, names


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES added.

    All of it is column arithmetic on arrays inside one row; nothing is shuffled.  A window is
    identified by a 64-bit hash of its words' 64-bit hashes.  Only documents in which some window
    occurs twice sort their windows, so the usual cost is linear in the words.
    """
    docs, names = set_aside(docs)
    t, words, hashes, windows, ordered, starts = (free_name(docs, f"__{x}") for x in ("t", "words", "hashes", "windows", "ordered", "starts"))
    df = docs.select("*", whole_text(docs[names[text]]).alias(t))
    trimmed = F.btrim(F.col(t), F.lit(SPACES))
    df = df.withColumn(words, F.when(F.length(trimmed) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    df = df.withColumn("n_words", F.size(words).cast("long")).withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    no_longs = F.expr("cast(array() as array<bigint>)")
    df = df.withColumn(
        windows,
        F.when(F.col("n_words") < WINDOW, no_longs).otherwise(F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))),
    )
    pairs = F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(
        ordered,
        F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(pairs)).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)")),
    )
    at = lambda k: F.get(F.col(ordered), k)["h"]
    twice = F.filter(F.col(ordered), lambda x, k: F.coalesce(x["h"] == at(k - 1), F.lit(False)) | F.coalesce(x["h"] == at(k + 1), F.lit(False)))
    df = df.withColumn(starts, F.sort_array(F.transform(twice, lambda x: x["i"])))
    reach = F.transform(F.col(starts), lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(starts), k + 1) - s, F.lit(WINDOW))))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    df = (
        df.withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_repeat_words", F.aggregate(reach, F.lit(0), lambda a, x: a + x).cast("long"))
        .drop(words, hashes, windows, ordered, starts)
        .withColumn(words, lines)
        .withColumn("n_lines", F.size(words).cast("long"))
        .withColumn("n_dup_lines", (F.size(words) - F.size(F.array_distinct(words))).cast("long"))
    )
    return df.drop(words, t)


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures and ``fail_bits`` (long): one bit for every rule that fails."""
    df = measure(docs, text)
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        bits = bits + F.when(F.expr(rule.fails), F.lit(rule.mask).cast("long")).otherwise(F.lit(0).cast("long"))
    return df.withColumn("fail_bits", bits)


def passes(mask: int, bits: str | Column = "fail_bits") -> Column:
    """Whether no rule of the mask failed."""
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(led: DataFrame, version: str = CURRENT, policies: dict[str, int] | None = None) -> DataFrame:
    """The ledger with ``kept`` under one policy version."""
    return led.drop("kept").withColumn("kept", passes((policies or POLICIES)[version]))


def kept_rows(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of a ledger that a policy keeps.

    A plain filter would be pushed below the measures, and each of their references evaluated anew;
    a condition on a row number, which is not deterministic, has to stay above them.
    """
    barrier = free_name(led, "__row")
    rows = apply_policy(led, version).withColumn(barrier, F.monotonically_increasing_id())
    return rows.filter(F.col("kept") & (F.col(barrier) >= 0)).drop(barrier)


def ablation(led: DataFrame, version: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: failed rows, rows it rejects alone, rows kept without it.

    One pass of bitwise aggregation over the ledger; the result has one row per rule.
    """
    mask = POLICIES[version]
    used = [r for r in rules if r.mask & mask]
    sums = [F.count("*").alias("rows"), F.coalesce(F.bit_or("fail_bits"), F.lit(0)).alias("seen_bits"), F.count_if(passes(mask)).alias("kept")]
    for r in used:
        sums += [F.count_if(~passes(r.mask)).alias(f"failed_{r.bit}"), F.count_if(passes(mask ^ r.mask)).alias(f"without_{r.bit}")]
    one = led.agg(*sums)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.bit).alias("bit"), F.col(f"failed_{r.bit}").alias("failed"), (F.col(f"without_{r.bit}") - F.col("kept")).alias("rejects_alone"), F.col(f"without_{r.bit}").alias("kept_without")) for r in used])
    return one.select("rows", "kept", "seen_bits", F.explode(rows).alias("r")).select("r.*", "rows", "kept", "seen_bits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the ledger of all documents under the current policy."""
    led = apply_policy(ledger(read_documents(spark, sf_dir).select("doc_id", "text")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), "kept", "fail_bits", "n_lines")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the current policy keeps, with their own columns."""
    aside, names = set_aside(docs)
    return kept_rows(ledger(aside)).select(*[F.col(new).alias(c) for c, new in names.items()])


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, sum(least(8, nxt - i)) AS n FROM (SELECT doc_id, i, lead(i, 1, i + 8) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
                 + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
                 + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, n_lines FROM b
"""

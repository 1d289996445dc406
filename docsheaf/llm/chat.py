"""Chat formatting: collapse of cumulative snapshots, then rendering.

Chat logs often hold a conversation once per turn, each row a longer snapshot.  Every turn prefix
gets a rolling key (its length and two 64-bit hashes).  A conversation is dropped when its whole key
is the key of a proper prefix of a longer one (anti-join), or when another conversation with the
same key has a smaller id; what remains is maximal and is rendered.

A key is the XOR of one hash per turn, taken over (place in the conversation, role, text), so a
prefix is a running XOR.  Places come from one global sort of all turns, which range partitions share out, so a
conversation may be spread over many tasks.  From then on all work is per block of BLOCK places of one
conversation, and a conversation is rendered as one part per block.

Defined cases: null roles and texts count as empty strings; null turns come first; turns with equal
numbers are ordered by role and the MD5 of their text; all turns with a null conversation id are one
conversation, with a null id; of equal conversations the smallest id stays, null last; repeated rows are
turns of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsheaf.llm.shared import cut
from docsheaf.llm.sharding import numbered

BLOCK = 256
ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>\n", "<|end|>\n"


def placed_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, role, text, nameless (no id), length (turns up to here), block."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select("conv_id", F.col("conv_id").isNull().alias("nameless"), "turn", role.alias("role"), text.alias("text"), F.md5(F.encode(text, "UTF-8")).alias("digest"))
    rows = numbered(turns, ["nameless", "conv_id", "turn", "role", "digest"])
    starts = rows.groupBy("nameless", F.col("conv_id").alias("of")).agg(F.min("row_number").alias("start"), F.count("*").alias("n_turns")).withColumnRenamed("nameless", "of_none")
    own = rows["conv_id"].eqNullSafe(starts["of"]) & (rows["nameless"] == starts["of_none"])
    length = F.col("row_number") - F.col("start") + 1
    return rows.join(starts, own).select("conv_id", "nameless", "role", "text", length.alias("length"), "n_turns", F.floor((length - 1) / BLOCK).alias("block"))


def prefix_keys(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, nameless, length, n_turns, key1, key2 of the prefix that ends there."""
    hashed = turns.select("conv_id", "nameless", "length", "n_turns", "block", F.xxhash64("length", "role", "text").alias("h1"), F.xxhash64("text", "role", "length", F.lit("second")).alias("h2"))
    before = Window.partitionBy("nameless", "conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy("nameless", "conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    carried = blocks.select(F.col("nameless").alias("of_none"), F.col("conv_id").alias("of"), F.col("block").alias("of_block"), *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))])
    running = Window.partitionBy("nameless", "conv_id", "block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("nameless") == F.col("of_none")) & (F.col("block") == F.col("of_block"))
    keys = [F.bit_xor(h).over(running).bitwiseXOR(F.col(c)).alias(k) for h, c, k in (("h1", "c1", "key1"), ("h2", "c2", "key2"))]
    return hashed.join(carried, same).select("conv_id", "nameless", "length", "n_turns", *keys)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, nameless and n_turns of the conversations that stay, from placed turns."""
    keys = cut(prefix_keys(turns))
    whole, proper = keys.filter("length = n_turns"), keys.filter("length < n_turns").select("length", "key1", "key2")
    unique = whole.groupBy("length", "key1", "key2").agg(F.min(F.struct("nameless", "conv_id")).alias("c"))
    return unique.join(proper.distinct(), ["length", "key1", "key2"], "left_anti").select("c.conv_id", "c.nameless", F.col("length").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per kept conversation and block of turns: conv_id, part, n_turns, rendered."""
    stays = kept.select(F.col("conv_id").alias("of"), F.col("nameless").alias("of_none"))
    rows = turns.join(stays, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("nameless") == F.col("of_none")), "left_semi")
    blocks = rows.groupBy("nameless", "conv_id", "n_turns", "block").agg(F.sort_array(F.collect_list(F.struct("length", "role", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: F.concat(F.lit(ROLE_OPEN), x["role"], F.lit(ROLE_CLOSE), x["text"], F.lit("\n" + TURN_END))), "")
    return blocks.select("conv_id", F.col("block").alias("part"), "n_turns", text.alias("rendered"))


def collapse(conversations: DataFrame) -> DataFrame:
    """The rendered parts of all conversations that no longer one begins with."""
    turns = cut(placed_turns(conversations))
    return render(turns, maximal(turns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: collapses and renders all conversations."""
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS turns FROM t GROUP BY conv_id),
u AS (SELECT turns, min(conv_id) AS conv_id, len(turns) AS n FROM c GROUP BY turns),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM u)),
k AS (SELECT conv_id, n FROM u ANTI JOIN p USING (turns))
SELECT t.conv_id, floor((t.place - 1) / 256)::BIGINT AS part, k.n::BIGINT AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""

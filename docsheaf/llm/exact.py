"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest.  New rows are reduced to one winner per
digest, anti-joined (sort-merge) with the index on the digest, and what is new is appended; the
bucketed side is not shuffled.  Only digests and row ids ever move, never a text.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``.  Of equal
texts the row with the most code points in its original text stays, then the smallest id.

Defined cases: a null text counts as empty, so all empty, blank and null texts are one group;
repeated rows (same id and text) each get a row, all of them kept; an empty table gives an empty result;
null ids are allowed and lose ties; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.llm.shared import chosen_rows, cut, free_name, new_path, read_documents, remove, row_keys, whole_text

#: Buckets of a new index; a production index of 100 TB would take some thousands.
BUCKETS = 32


def digest(text: str | Column = "text") -> Column:
    """SHA-256 (32 bytes) of the text without spaces."""
    return F.unhex(F.sha2(F.encode(F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", ""), "UTF-8"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", more: Sequence[Column] = ()) -> DataFrame:
    """(id, digest, n_chars): all that deduplication needs of a row; then the columns ``more``."""
    return docs.select(docs[id_col].alias("id"), digest(docs[text]).alias("digest"), F.length(whole_text(docs[text])).cast("long").alias("n_chars"), *more)


class DigestIndex:
    """A digest table (digest, keep_id, n_chars) at ``path``; reopening the path finds it again."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, n_chars BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """Adds (digest, keep_id, n_chars) rows; dealt by digest as the buckets are, so each task writes one file."""
        fresh.select("digest", "keep_id", "n_chars").repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def drop(self) -> None:
        """Forgets the index and deletes its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)

    def ingest(self, rows: DataFrame) -> DataFrame:
        """Adds the new digests of ``rows`` (see digests()); returns their groups.

        The groups: digest, keep_id, group_size (rows of this batch).  Where the index had the digest
        before, keep_id is the index's.
        """
        groups = winners(rows)
        fresh = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self.append(fresh)
        return groups.select("digest", "group_size").join(self.read().select("digest", "keep_id").hint("merge"), "digest")


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: digest, keep_id, n_chars, group_size.  Map-side combine makes hot digests cheap."""
    best = F.max(F.struct("n_chars", (-F.col("id")).alias("neg")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select("digest", (-F.col("best.neg")).alias("keep_id"), F.col("best.n_chars").alias("n_chars"), "group_size")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, digest.

    The digests are cut once, so texts are read and hashed a single time.  The groups are cut too:
    both sides of the last join then come from plain shuffles, and Spark splits a hot digest's rows
    over several tasks.  Without an ``index`` a new one serves this call alone.
    """
    spark = docs.sparkSession
    own = index or DigestIndex(spark, new_path(spark, "digest-index"))
    rows = cut(digests(docs, id_col, text))
    groups = cut(own.ingest(rows))
    if index is None:
        own.drop()
    out = rows.join(groups, "digest")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: deduplicates all documents into a new index."""
    out = deduplicate(read_documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each digest group stays, with its own columns; a new index, anti-joined and appended to, names its id.

    Rows are known by id and text, so rows that share an id, null too, but no digest stay side by side.  A row
    that stands several times is counted where it is read, so its copies are one entry in any shuffle of keys.
    """
    k1, k2 = free_name(docs, "k1"), free_name(docs, "k2")
    keys = dict(zip((k1, k2), row_keys(docs["doc_id"], docs["text"]), strict=True))
    rows = cut(digests(docs, more=[k.alias(n) for n, k in keys.items()]).groupBy("digest", "n_chars", "id", k1, k2).agg(F.count("*").alias("copies")))
    index = DigestIndex(spark, new_path(spark, "digest-index"))
    groups = cut(index.ingest(rows.select("digest", "n_chars", "id")).select(F.col("digest").alias("own"), "keep_id"))
    index.drop()
    kept = rows.join(groups, (rows["digest"] == groups["own"]) & rows["id"].eqNullSafe(groups["keep_id"]))
    chosen = kept.groupBy("digest").agg(F.max(F.struct("n_chars", k1, k2, "copies")).alias("best")).select(f"best.{k1}", f"best.{k2}", "best.copies")
    return chosen_rows(docs, keys, chosen)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS kept, text_sha256
FROM d
"""

"""Helpers that the corpus operators share: the shared folder, checkpoints, text constants."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words everywhere in this subpackage: x20 and x09 to x0D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a new local one only where that is unset and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return (named or jsc.getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that nothing reads any more, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_keys(id_col: str | Column = "doc_id", text: str | Column = "text") -> list[Column]:
    """Two 64-bit hashes that stand for a row's id and text; only rows with the same id, null too, and text share both."""
    one = F.col(id_col) if isinstance(id_col, str) else id_col
    parts = [one.isNull(), F.coalesce(one.cast("string"), F.lit("")), whole_text(text)]
    return [F.xxhash64(*parts), F.xxhash64(parts[2], parts[1], parts[0], F.lit("second"))]


def chosen_rows(docs: DataFrame, keys: dict[str, Column], chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys are in ``chosen`` (the names in ``keys``, copies); of equal rows one if copies > 1.

    Texts are shuffled once, for an inner join on unique keys.  Both branches read that one exchange; the
    second, of rows that stand several times in ``docs``, is mostly empty, and its rows are combined
    before they are dealt out again, so a row repeated very often does not end in one task.
    """
    names = list(keys)
    keyed = docs.select("*", *[k.alias(n) for n, k in keys.items()])
    copies = free_name(docs, "copies")
    chosen = chosen.withColumnRenamed("copies", copies)
    single = keyed.join(chosen.filter(F.col(copies) == 1), names).select(*docs.columns)
    again = [free_name(keyed, f"again{i}") for i in range(len(names))]
    several = keyed.join(chosen.filter(F.col(copies) > 1), names).withColumns({a: F.col(n).bitwiseXOR(F.lit(1)) for a, n in zip(again, names, strict=True)})
    return single.unionByName(several.dropDuplicates(again).select(*docs.columns))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name

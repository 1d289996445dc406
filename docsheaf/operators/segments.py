"""Ordered rows of a document: pages, lines, carried values, sections, batches by budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsheaf.operators.folds import fold_groups

PAGE_MARK = r"--- Page (\d+) \(([^)]*)\) ---\n?"


def pages(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, page_no, layer, text) of page-marked texts, and the ids of texts that have a page twice."""
    marks = F.regexp_extract_all(F.col(text), F.lit(PAGE_MARK), F.lit(1))
    layers = F.regexp_extract_all(F.col(text), F.lit(PAGE_MARK), F.lit(2))
    bodies = F.slice(F.split(F.col(text), PAGE_MARK), 2, F.greatest(F.size(marks), F.lit(1)))
    rows = docs.select(id_col, F.explode(F.arrays_zip(marks.alias("page_no"), layers.alias("layer"), bodies.alias("text"))).alias("p"))
    rows = rows.select(id_col, F.col("p.page_no").cast("int").alias("page_no"), "p.layer", "p.text").filter("page_no is not null")
    twice = rows.groupBy(id_col, "page_no").count().filter("count > 1").select(id_col).distinct()
    return rows.join(twice, id_col, "left_anti"), twice


def page_coverage(rows: DataFrame, doc: str, page: str, body: Column, first: int = 1) -> DataFrame:
    """Per document: whether its pages are exactly first..N, each once and with a body."""
    p = F.col(page)
    whole = (F.min(p) == first) & (F.max(p) - first + 1 == F.count("*")) & (F.count_distinct(p) == F.count("*")) & F.bool_and(body)
    return rows.groupBy(doc).agg(F.count("*").alias("pages"), F.max(p).alias("last_page"), F.coalesce(whole, F.lit(False)).alias("complete"))


def carried(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Every row with the last value at or above it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def sections(rows: DataFrame, keys: list[str], order: str, opens: Column, name: str = "section") -> DataFrame:
    """Numbers the stretches that begin where ``opens`` is true; rows before the first are in section 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(opens, 1).otherwise(0)).over(w))


def specimens(rows: DataFrame, doc: str, page: str, is_cover: Column, key: Column) -> DataFrame:
    """Pages with their specimen: a cover opens a pending one, the next key binds it, a change of key opens another."""
    ordered = Window.partitionBy(doc).orderBy(page)
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    df = rows.withColumns({"__cover": F.coalesce(is_cover, F.lit(False)), "__key": key})
    before = df.withColumn("__last", F.last("__key", ignorenulls=True).over(upto)).withColumn("__covers", F.count_if("__cover").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    bound = Window.partitionBy(doc, "__covers").orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    pending = (F.col("__covers") > 0) & F.coalesce(F.count("__key").over(bound) == 0, F.lit(True))
    changed = F.col("__key").isNotNull() & ~F.col("__key").eqNullSafe(F.col("__last")) & ~(pending & ~F.col("__cover"))
    opens = F.col("__cover") | changed
    return sections(before.withColumn("__opens", opens), [doc], page, F.col("__opens"), "specimen").drop("__cover", "__key", "__last", "__covers", "__opens")


def first_marker(docs: DataFrame, id_col: str, lines: Column, markers: Column | str, excerpt: int = 8, width: int = 360) -> DataFrame:
    """(id, line_no, excerpt, located): the first line with a marker and what follows it; never a made-up place."""
    pattern = markers if isinstance(markers, str) else None
    df = docs.select(id_col, lines.alias("__lines"))
    numbers = F.transform("__lines", lambda x, i: F.when(x.rlike(pattern) if pattern else F.contains(x, markers), i + 1))
    at = F.array_min(F.array_compact(numbers))
    df = df.withColumn("line_no", at)
    text = F.left(F.array_join(F.slice("__lines", F.coalesce("line_no", F.lit(1)), F.lit(excerpt)), "\n"), F.lit(width))
    return df.select(id_col, "line_no", F.when(F.col("line_no").isNotNull(), text).alias("excerpt"), F.col("line_no").isNotNull().alias("located"))


def packed(rows: DataFrame, doc: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each document in order, with batches of at most ``budget``; a row over it is a batch of its own.

    Greedy, so sequential inside a document; documents are independent.  Rows without a document are one document; a null size
    counts as 0.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, used, last = 0, 0, object()
        for rows in batches:
            out = []
            for key, n in zip(rows.column(doc).to_pylist(), rows.column(size).to_pylist(), strict=True):
                if key != last:
                    batch, used, last = 0, 0, key
                if used and used + (n or 0) > budget:
                    batch, used = batch + 1, 0
                used += n or 0
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int64())], names=[*rows.schema.names, "batch"])

    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])
    return rows.repartition(doc).sortWithinPartitions(doc, order).mapInArrow(pack, schema)


def islands(rows: DataFrame, keys: list[str], order: str, gap: float, name: str = "island") -> DataFrame:
    """Stretches of ordered values without a gap larger than ``gap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return sections(rows.withColumn("__far", F.coalesce(F.col(order) - F.lag(order).over(w) > gap, F.lit(True))), keys, order, F.col("__far"), name).drop("__far")


def text_lines(words: DataFrame, keys: list[str], top: str = "top", left: str = "left", right: str = "right", gap: float = 3, tab: float = 18) -> DataFrame:
    """(keys, line, text): words in lines; a word more than ``gap`` below a line's first word opens the next line.

    The comparison is with the first word, so it is sequential inside a page; in a line, words stand by x and
    wide gaps become tabs.
    """

    late = lambda x: (x is None, x if x is not None else 0.0)

    def cluster(rows: list[tuple]) -> list[tuple]:
        found: list[list[tuple]] = []
        first = None
        for row in rows:
            y = row[0]
            if not found or (y is not None and first is not None and y - first > gap):
                found.append([])
                first = y
            found[-1].append(row)
        out = []
        for n, own in enumerate(found):
            text, edge = "", None
            for k, (_, x, end, word) in enumerate(sorted(own, key=lambda r: late(r[1]))):
                far = x is not None and edge is not None and x - edge > tab
                text += ("" if k == 0 else "\t" if far else " ") + word
                edge = end
            out.append((n, text))
        return out

    order = [F.col(c).asc_nulls_last() for c in (top, left, right, "text")]
    return fold_groups(words, keys, order, [top, left, right, "text"], cluster, [T.StructField("line", T.LongType()), T.StructField("text", T.StringType())])

"""Readers: rule packages, knowledge trees, uploaded binaries, block lists, HTML grids and list pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "cell_id string, table_no int, row_no int, col_no int, text string, rowspan int, colspan int"


def rule_package(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, models, errors) of JSON packages.  Errors: duplicate units or models, requirements that name unknown models."""
    raw = spark.read.schema("units array<struct<code:string,name:string,models:array<struct<id:string,name:string>>,requirements:array<struct<id:string,kind:string,models:array<string>>>>>").json(path, multiLine=True)
    units = raw.select(F.explode("units").alias("u")).select("u.*")
    models = units.select(F.col("code").alias("unit_code"), F.explode("models").alias("m")).select("unit_code", F.col("m.id").alias("model_id"), F.col("m.name").alias("name"))
    named = units.select(F.explode("requirements").alias("r")).select(F.explode("r.models").alias("model_id"))
    twice = lambda df, c, what: df.groupBy(c).count().filter("count > 1").select(F.lit(what).alias("error"), F.col(c).alias("value"))
    errors = twice(units, "code", "duplicate_unit").unionByName(twice(models, "model_id", "duplicate_model")).unionByName(named.join(models, "model_id", "left_anti").distinct().select(F.lit("unknown_model").alias("error"), F.col("model_id").alias("value")))
    return units, models, errors


def catalogue(units: DataFrame, models: DataFrame) -> DataFrame:
    """Units in order with their models in order; units without any have an empty list."""
    per = models.groupBy("unit_code").agg(F.array_sort(F.collect_list(F.struct("model_id", "name"))).alias("models"))
    empty = F.expr("cast(array() as array<struct<model_id:string,name:string>>)")
    return units.select("code", "name").join(per.withColumnRenamed("unit_code", "code"), "code", "left").withColumn("models", F.coalesce("models", empty)).orderBy("code")


def knowledge(spark: SparkSession, path: str, family: str | None = None) -> DataFrame:
    """(path, text) of all text files below a folder, comments stripped; a family limits them to its own and shared ones."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.btrim(F.regexp_replace(F.regexp_replace("value", r"(?s)<!--.*?-->", ""), r"(?m)^\s*#.*$", ""), F.lit(" \r\n\t")).alias("text"))
    return df if family is None else df.filter(F.col("path").contains(f"/{family}/") | F.col("path").contains("/common/"))


def uploads(spark: SparkSession, path: str, extensions: list[str], most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) binary files with sha256; content of rejected ones is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.substring_index("path", ".", -1))
    reason = F.when(~kind.isin(extensions), "extension").when(F.col("length") > most_bytes, "size").when(F.col("length") == 0, "empty")
    marked = files.withColumn("reason", reason)
    return marked.filter("reason is null").select("path", "length", F.sha2("content", 256).alias("sha256"), "content"), marked.filter("reason is not null").select("path", "length", "reason")


def block_pages(docs: DataFrame, id_col: str, blocks: str) -> DataFrame:
    """(id, page_no, text) of JSON block lists (page_idx from 0, type, text), in block order."""
    rows = docs.select(id_col, F.posexplode(F.from_json(blocks, "array<struct<page_idx:int,type:string,text:string>>")).alias("pos", "b"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("b.text", F.lit("")).alias("t"))))
    return rows.groupBy(id_col, (F.col("b.page_idx") + 1).alias("page_no")).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))


class _Tables(HTMLParser):
    """Collects the rows of the outermost tables as (text, rowspan, colspan) cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.depth = 0
        self.open = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
            self.open = False
        elif self.depth == 1 and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            span = {k: int(v) if (v or "").strip().isdigit() else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            self.tables[-1][-1].append(["", max(1, span.get("rowspan", 1)), max(1, span.get("colspan", 1))])
            self.open = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.depth and self.open:
            self.tables[-1][-1][-1][0] += data


def grids(html: str | None) -> list[list[list[tuple[str, int, int]]]]:
    """Rectangular grids: a spanning cell is repeated in all the places it covers."""
    parser = _Tables()
    parser.feed(html or "")
    out = []
    for table in parser.tables:
        filled: dict[tuple[int, int], tuple[str, int, int]] = {}
        for r, row in enumerate(table):
            c = 0
            for text, down, across in row:
                while (r, c) in filled:
                    c += 1
                for i in range(r, min(r + down, len(table))):
                    for j in range(c, c + across):
                        filled[i, j] = (" ".join(text.split()), down, across)
                c += across
        width = 1 + max((j for _, j in filled), default=-1)
        out.append([[filled.get((r, c), ("", 1, 1)) for c in range(width)] for r in range(len(table))])
    return out


def cells(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """One row per grid place of every table of every page, with an id (table, row, column) that references name."""
    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys) + ", " + CELLS

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for own, text in zip(frame[keys].itertuples(index=False, name=None), frame[html], strict=True):
                rows += [(*own, f"t{t}r{r}c{c}", t, r, c, *cell) for t, grid in enumerate(grids(text)) for r, row in enumerate(grid) for c, cell in enumerate(row)]
            yield pd.DataFrame(rows, columns=[*keys, "cell_id", "table_no", "row_no", "col_no", "text", "rowspan", "colspan"])

    return pages.select(*keys, html).mapInPandas(parse, schema)


def header_rows(grid: DataFrame, keys: list[str], synonyms: dict[str, list[str]]) -> DataFrame:
    """The first row of each table that has a cell for every role."""
    role = F.lit(None).cast("string")
    for name, words in synonyms.items():
        role = F.when(F.regexp_replace("text", r"(?U)\s+", "").isin(words), F.lit(name)).otherwise(role)
    rows = grid.withColumn("role", role).filter("role is not null").groupBy(*keys, "table_no", "row_no").agg(F.count_distinct("role").alias("n"))
    return rows.filter(F.col("n") == len(synonyms)).groupBy(*keys, "table_no").agg(F.min("row_no").alias("header_row"))


def list_records(pages: DataFrame, id_col: str, html: str, item: str, record_id: str, link: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, issues) of a list page's items: exactly one id and one link make a record; repeats are issues."""
    items = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(item), F.lit(1))).alias("pos", "item"))
    ids, links = (F.array_distinct(F.regexp_extract_all("item", F.lit(p), F.lit(1))) for p in (record_id, link))
    read = items.select(id_col, "pos", ids.alias("ids"), links.alias("links"))
    reason = F.when(F.size("ids") != 1, "id").when(F.size("links") != 1, "link")
    read = read.withColumns({"reason": reason, "record_id": F.get("ids", F.lit(0)), "link": F.get("links", F.lit(0))}).drop("ids", "links")
    good = read.filter("reason is null").drop("reason")
    first = good.groupBy(id_col, "record_id").agg(F.min("pos").alias("pos"))
    accepted = good.join(first, [id_col, "record_id", "pos"], "left_semi")
    repeated = good.join(first, [id_col, "record_id", "pos"], "left_anti").withColumn("reason", F.lit("repeated"))
    return accepted, read.filter("reason is not null").unionByName(repeated.select(*read.columns))


def item_column(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"<[^>]*>", " "))


def tree(files: DataFrame, path: str, levels: int = 3) -> DataFrame:
    """Files per folder at every level of their paths, the whole tree first: level, folder, files."""
    parts = F.split(F.regexp_replace(path, r"^[a-z]+:/*|^/+", ""), "/")
    rows = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(levels), F.size(parts) - 1)), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))).alias("t"))
    return rows.groupBy("t.level", "t.folder").agg(F.count("*").alias("files"))


def marked_pages(pages: DataFrame, keys: list[str], page: str, text: str, marker: str, header: str) -> tuple[DataFrame, DataFrame]:
    """(pages with a marker, keys whose header stands on several pages): extra evidence is only read where the header is unique."""
    shown = pages.filter(F.regexp_like(text, F.lit(marker)))
    twice = pages.filter(F.regexp_like(text, F.lit(header))).groupBy(*keys).agg(F.count_distinct(page).alias("pages")).filter("pages > 1")
    return shown.join(twice, keys, "left_anti"), twice


def table_lines(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_no, row_no, owner, line): a line per table row; rows whose first cell is empty are conditions of the item above."""
    cells = F.array_sort(F.collect_list(F.struct("col_no", "text")))
    rows = grid.groupBy(*keys, "table_no", "row_no").agg(F.transform(cells, lambda c: c["text"]).alias("cells"))
    first = F.trim(F.get("cells", F.lit(0)))
    w = Window.partitionBy(*keys, "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("owner", F.last(F.nullif(first, F.lit("")), ignorenulls=True).over(w)).select(*keys, "table_no", "row_no", "owner", F.array_join(F.filter("cells", lambda c: F.trim(c) != ""), " | ").alias("line"))

"""Reading the driver tables; the only place that knows their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a narrow table that one task takes, where texts are made of them.
TASK_ROWS = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by its keys over as many tasks as its rows need.

    Files of narrow rows are small, so splits by bytes leave a task millions of rows, from which the queries make texts
    many times as large.  The number of rows comes from the files' footers.
    """
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > 1 else df

"""Folding the ordered rows of small groups in Python, many groups per batch.

One shuffle and sort bring a group's rows together; then batches stream through, so the cost per group
is a few calls, not a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def fold_groups(df: DataFrame, keys: list[str], order: Sequence[str | Column], columns: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], out: list[T.StructField]) -> DataFrame:
    """(keys, out): ``fold`` maps the tuples (columns) of a group, in order, to result tuples."""
    n = len(keys)
    names = [*keys, *[f.name for f in out]]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            frame = frame[[*keys, *columns]].astype(object)
            yield from frame.where(frame.notna(), None).itertuples(index=False, name=None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[Any, ...]] = []
        for key, own in groupby(rows(frames), key=itemgetter(*range(n)) if n > 1 else itemgetter(slice(0, 1))):
            held += [(*key, *r) for r in fold([r[n:] for r in own])]
            if len(held) >= 10_000:
                yield pd.DataFrame(held, columns=names)
                held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    schema = T.StructType([*[df.schema[k] for k in keys], *out])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)

"""Periodic runs: stretches of words that repeat with a smallest period, found by suffix-tree LCE.

1. Stretches.  A run of at least ``min_length`` words and two periods is covered by windows of half that many words
   that occur twice in the text (proof in _stretches), so texts are cut to the stretches of such windows
   first.  Windows are compared by hash: a collision only adds words to a stretch.
2. Trees.  Ukkonen's algorithm builds the suffix tree of a stretch and of its reversal.  An Euler tour with
   a table of range minima answers how far two suffixes agree (the depth of their lowest common ancestor)
   in constant time, for all questions at once.
3. Lyndon roots.  Each run has a period that is the longest Lyndon word from its place, in the order of words or in the
   reverse order.  The longest Lyndon word from a place ends where the next smaller suffix begins; the tree's leaves
   in order rank the suffixes.  Each such word is extended to the right by the one tree and to the left by the
   other; at two periods or more it is a run, and no run is missed.

Every text is one row's work, linear in its repeated words but for the table of minima (n log n).

Defined cases: null, empty and blank texts have no runs and an empty collapsed text; a text is never cut; runs
of one stretch of words with different periods are all reported, by start, then period; repeated rows each
get a row; an empty table gives an empty result; other columns are kept, and one that is named like a
new one gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsheaf.llm.shared import free_name, read_documents, whole_text
from docsheaf.llm.tokens import slices

#: A run has at least so many words, and two periods.
MIN_LENGTH = 12
#: UTF-8 bytes of text that a task turns into words at once.
BATCH_BYTES = 4_000_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SuffixTree:
    """Ukkonen's tree of a sequence of numbers from 0, with an end mark of its own (-1) that is smaller than all."""

    def __init__(self, items: list[int]):
        self.items = items = [*items, -1]
        size = len(items)
        self.begin, self.end, self.kids = begin, end, kids = [0], [0], [{}]
        link = [0]
        node = edge = matched = open_ = 0
        for at, item in enumerate(items):
            open_ += 1
            waiting = 0
            while open_:
                if not matched:
                    edge = at
                below = kids[node]
                child = below.get(items[edge])
                if child is None:
                    below[items[edge]] = len(begin)
                    begin.append(at), end.append(size), link.append(0), kids.append(None)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    first = begin[child]
                    stop = end[child]
                    width = (stop if stop <= at else at + 1) - first
                    if matched >= width:
                        node, edge, matched = child, edge + width, matched - width
                        continue
                    if items[first + matched] == item:
                        matched += 1
                        if waiting:
                            link[waiting] = node
                        break
                    middle = len(begin)
                    begin.append(first), end.append(first + matched), link.append(0), kids.append({items[first + matched]: child, item: middle + 1})
                    begin[child] = first + matched
                    begin.append(at), end.append(size), link.append(0), kids.append(None)
                    below[items[edge]] = middle
                    if waiting:
                        link[waiting] = middle
                    waiting = middle
                open_ -= 1
                if node:
                    node = link[node]
                elif matched:
                    matched -= 1
                    edge = at - open_ + 1

    def leaves(self) -> Iterator[int]:
        """The leaves in the order they were made, which is that of their suffixes."""
        return (k for k, below in enumerate(self.kids) if below is None)

    def tour(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """An Euler tour in the order of items: depths met, where each suffix's leaf is met, the suffixes in order."""
        suffix = {leaf: k for k, leaf in enumerate(self.leaves())}
        begin, end, kids = self.begin, self.end, self.kids
        depths: list[int] = []
        met, order = [0] * len(suffix), []
        stack: list[tuple[int, int]] = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            below = kids[node] if node >= 0 else None
            if below is None:
                if node >= 0:
                    own = suffix[node]
                    met[own] = len(depths)
                    order.append(own)
                depths.append(depth)
                continue
            depths.append(depth)
            for item in sorted(below, reverse=True):
                child = below[item]
                stack.append((-1, depth))
                stack.append((child, depth + end[child] - begin[child]))
        return np.array(depths, dtype=np.int32), np.array(met), order

    def backward(self) -> list[int]:
        """The suffixes in the reverse order of items, but each before what it begins."""
        suffix = {leaf: k for k, leaf in enumerate(self.leaves())}
        kids, order, stack = self.kids, [], [0]
        while stack:
            node = stack.pop()
            below = kids[node]
            if below is None:
                order.append(suffix[node])
                continue
            stack += [below[item] for item in sorted(below) if item >= 0]
            if -1 in below:
                stack.append(below[-1])
        return order


class Extensions:
    """How many items two suffixes of a sequence share, in constant time a question."""

    def __init__(self, depths: np.ndarray, met: np.ndarray):
        self.met, self.rows = met, [depths]
        width = 1
        while 2 * width <= len(depths):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different suffixes a[k] and b[k]: the least depth on the tour between their leaves."""
        a, b = self.met[a], self.met[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            row = self.rows[k]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << k) + 1])
        return out


def _next_smaller(order: list[int]) -> list[int]:
    """For each suffix where the next one that comes before it in ``order`` begins; their number where none does."""
    rank = [0] * len(order)
    for k, own in enumerate(order):
        rank[own] = k
    out, open_ = [len(order)] * len(order), []
    for k, own in enumerate(rank):
        while open_ and rank[open_[-1]] > own:
            out[open_.pop()] = k
        open_.append(k)
    return out


def tree_runs(items: list[int]) -> np.ndarray:
    """All runs (start, length, period) of a sequence of numbers, of two periods or more."""
    n = len(items)
    tree = SuffixTree(items)
    depths, met, order = tree.tour()
    roots = [_next_smaller(order)[:n], _next_smaller(tree.backward())[:n]]
    del tree
    at = np.concatenate([np.arange(n)] * 2)
    after = np.minimum(np.concatenate(roots), n)
    at, after = np.unique(np.stack([at, after]), axis=1)
    right = Extensions(depths, met)(at, after)
    depths, met, _ = SuffixTree(items[::-1]).tour()
    left = Extensions(depths, met)(n - at, n - after)
    period, start = after - at, at - left
    length = after + right - start
    return np.unique(np.stack([start, length, period], axis=1)[length >= 2 * period], axis=0)


def _stretches(items: np.ndarray, min_length: int) -> list[tuple[int, int]]:
    """The stretches [from, to) whose words all lie in windows that occur twice; they hold every run.

    A run of L words and period q repeats its first L - q words q words later.  L - q is at least half of min_length,
    as L >= min_length and L >= 2 q.  So the windows of that size from its start up to its last period, and those q
    words later, occur twice, and they cover it, as L >= 2 q.
    """
    window = max(1, (min_length + 1) // 2)
    count = len(items) - window + 1
    if count < 2:
        return []
    mixed = (items.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashed = mixed[:count].copy()
    for k in range(1, window):
        hashed = hashed * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + count]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(count, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(items) + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + window, -1)
    inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= min_length]


def runs_of(words: list, min_length: int = MIN_LENGTH) -> np.ndarray:
    """The runs (start, length, period) of at least ``min_length`` items, by start, then period."""
    seen: dict = {}
    items = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    found = [np.zeros((0, 3), dtype=np.int64)]
    for a, b in _stretches(items, min_length):
        own = tree_runs(np.unique(items[a:b], return_inverse=True)[1].tolist())
        found.append(own[own[:, 1] >= min_length] + np.array([a, 0, 0]))
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that some run has after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def _found(text: str, runs: str, collapsed: str, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                all_runs, texts = [], []
                for value in part.column(text).to_pylist():
                    words = (value or "").encode().split()
                    own = runs_of(words, min_length)
                    all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()])
                    texts.append((b" ".join(words) if not len(own) else b" ".join([words[k] for k in np.flatnonzero(kept_words(len(words), own)).tolist()])).decode())
                keep = [c for c in part.column_names if c != text]
                columns = [*[part.column(c) for c in keep], pa.array(all_runs, _ARROW_RUNS), pa.array(texts, pa.string())]
                yield from pa.table(columns, names=[*keep, runs, collapsed]).combine_chunks().to_batches()

    return run


def periodic_runs(docs: DataFrame, text: str | Column = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with ``runs`` (by start, then period) and ``collapsed``, the words that no run repeats, joined by spaces."""
    keep = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    own = free_name(docs, "__text")
    rows = docs.select(*[docs[c] for c in keep], whole_text(docs[text] if isinstance(text, str) else text).alias(own))
    schema = T.StructType([f for f in rows.schema.fields if f.name != own] + T.StructType.fromDDL(f"runs {RUNS}, collapsed string").fields)
    return rows.mapInArrow(_found(own, "runs", "collapsed", min_length), schema)


def longest(runs: str = "runs") -> Column:
    """The longest run; of equals that of the smallest start, then period.  Null where there is none."""
    better = lambda a, b: a.isNull() | (b["length"] > a["length"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda a, b: F.when(better(a, b), b).otherwise(a))


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The contract's input: of texts whose id's crc32 ends in 0, the words from some place on become periodic."""
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(whole_text(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def rewritten(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % period).cast("int"))), " "))

    once = F.transform(F.array(words), rewritten)
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.get(once, 0)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the runs of all documents, a tenth of them made periodic."""
    docs = read_documents(spark, sf_dir)
    found = periodic_runs(docs.select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text")))
    rows = found.select("doc_id", "runs", "collapsed", longest().alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Near-duplicate detection by one-permutation hashing: banded buckets, stars, and whole bins for the rest.

1. Sketches.  The distinct shingles of a text are hashed once; the upper bits of a hash are its bin, and the least hash of
   each of BINS bins is the sketch.  An empty bin takes the value of a bin that its own sequence of hashes meets
   first (optimal densification), so that any two sets agree in a bin with the probability of their similarity.
2. Nodes.  Documents with the same set are one node, known by a 64-bit hash of the set.
3. Buckets.  ROWS neighbouring bins are a band; nodes that agree in a whole band share a bucket.
4. Stars.  In every bucket that holds nodes of several components one node is the centre, and only pairs of it and the
   nodes of other components are candidates: at most one per node and band, whatever a bucket holds.  There are ROUNDS
   rounds; each draws its own centres.
5. Whole bins, exactly.  Linked sets differ in at most d shingles, which their sizes bound.  So of d + 1 + z bins
   at least 1 + z hold the same shingles in both, and one of these isn't empty, unless both sets have more than z empty bins:
   such sets share a key of their own.  Bins are as many as the larger size of two neighbouring size classes needs, and
   linked sizes are in the same or in neighbouring classes.  All pairs of nodes that agree in a whole bin and are of
   different components are candidates, so the stars only save work, and no link is lost.  Hash collisions aside, that is exact.
6. Filters.  A parity signature of each set bounds the difference of two sets from below: first a short one in the bins, then
   one of as many bits as the set has shingles.  What they leave is confirmed on the full sets, which are made once
   more from the texts of these few nodes; links join components.

A large bin is split into parts, so that every two of them meet in one task.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; a text of fewer words than a
shingle is one shingle; repeated rows are copies; rows with a null id take the smallest id of their component, null if
there is none, and stay unless the component has another row with an id; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsheaf.llm.components import components
from docsheaf.llm.ngram import _mixed, _squeezed, _stretched, shingles
from docsheaf.llm.shared import cut, read_documents
from docsheaf.llm.tokens import slices

WORDS, PERCENT = 3, 85
#: Bins of a sketch (a power of two); bins in one band.  21 bands of 6 use 126 of the 128 bins.
BINS, ROWS = 128, 6
#: Rounds of stars, with one centre in a bucket; nodes of a whole bin that meet in one task.
ROUNDS, BLOCK_NODES = 2, 1000
#: Words of 64 marks that tell which texts are needed: a fixed size, whatever the input.
MARK_WORDS = 1 << 17
#: Bits of a shingle hash, and of a short signature; UTF-8 bytes of text that are sketched at once.
HASH_BITS, SHORT_BITS, BATCH_BYTES = 56, 512, 6_000_000
_DOC = pa.struct([("doc_id", pa.int64()), ("n", pa.int32()), ("t1", pa.int64()), ("t2", pa.int64()), ("short", pa.binary()), ("signature", pa.binary())])
_KEYED_TYPE = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("doc", _DOC)])
KEYED_SCHEMA = "key long, node long, doc struct<doc_id:long,n:int,t1:long,t2:long,short:binary,signature:binary>"
_BLOCK_TYPE = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("component", pa.int64()), ("own", pa.bool_())])
_PAIR_TYPE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("nu", pa.int32()), ("nv", pa.int32())])


def detours(bins: int, tries: int = 64) -> np.ndarray:
    """detours[t, j]: the bin that the empty bin j looks at in its try t."""
    rng = np.random.Generator(np.random.PCG64(20_170_301))
    return rng.integers(0, bins, size=(tries, bins))


def sketch(own: np.ndarray, bins: int, ways: np.ndarray) -> np.ndarray:
    """The densified sketch of a sorted set of hashes that isn't empty."""
    width = np.uint64(HASH_BITS - bins.bit_length() + 1)
    edges = np.searchsorted(own, np.arange(bins + 1, dtype=np.uint64) << width)
    full = edges[1:] > edges[:-1]
    values = own[np.minimum(edges[:-1], len(own) - 1)]
    if full.all():
        return values
    source, empty = np.arange(bins), np.flatnonzero(~full)
    for way in ways:
        source[empty] = way[empty]
        empty = empty[~full[source[empty]]]
        if not len(empty):
            break
    for j in empty.tolist():  # all tries met empty bins: the next full one
        source[j] = np.flatnonzero(full)[np.searchsorted(np.flatnonzero(full), j) % int(full.sum())]
    return values[source]


def band_hashes(values: np.ndarray, rows: int) -> list[int]:
    """One signed 64-bit hash per band."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(values[b * rows : (b + 1) * rows].tobytes(), seed=b) - (1 << 63) for b in range(len(values) // rows)]


@cache
def size_classes(percent: int, top: int = 1 << 31) -> list[int]:
    """The least size of each class; linked sizes are in the same or in neighbouring classes."""
    least = [1, 2]
    while least[-1] <= top:
        least.append(max(least[-1] + 1, (least[-1] - 1) * 100 // percent + 1))
    return least


@cache
def whole_bins(size_class: int, percent: int) -> tuple[int, int]:
    """(bins, z): linked sets of this class and the one below agree in more than z of the bins; few sets have more than z empty ones."""
    least = size_classes(percent)
    apart = (100 - percent) * 2 * (least[size_class + 1] - 1) // (100 + percent)
    smallest, z = least[max(0, size_class - 1)], 0
    while z < max(1, apart // 4):
        bins = apart + 1 + z
        empty = bins * (1 - 1 / bins) ** smallest
        if sum(math.exp(-empty) * empty**i / math.factorial(i) for i in range(z + 1)) > 0.999 if empty < 50 else z > empty + 5 * math.sqrt(empty):
            break
        z += 1
    return apart + 1 + z, z


def bin_keys(own: np.ndarray, percent: int) -> list[np.ndarray]:
    """The keys of a set's whole bins, in its own size class and the next one; a key of the class if more than z are empty.

    Keys are even; the bit above tells whether the class is odd.
    """
    mixed, out = _mixed(own), []
    first = bisect_right(size_classes(percent), len(own)) - 1
    for size_class in (first, first + 1):
        bins, z = whole_bins(size_class, percent)
        number = (own >> np.uint64(HASH_BITS - 32)) * np.uint64(bins) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        keys = _mixed(_mixed(np.add.reduceat(mixed, starts) + np.uint64(size_class)) + number[starts])
        if bins - len(starts) > z:
            keys = np.append(keys, _mixed(np.array([size_class], dtype=np.uint64)))
        out.append(keys >> np.uint64(2) << np.uint64(2) | np.uint64(2 * (size_class % 2)))
    return out


def signature(own: np.ndarray) -> bytes:
    """For each of as many classes of shingles as the set has shingles, at least, whether it has an odd number of them."""
    bits = max(SHORT_BITS, 1 << (len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(odd: np.ndarray, size: int) -> np.ndarray:
    """A signature (64-bit words) with ``size`` words: classes that become one are odd if one of them is."""
    while len(odd) > size:
        odd = odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]
    return odd


def _keyed(words: int, percent: int, bins: int, rows: int):
    """A row per document, and one for every key of the sets that are new in the task: odd keys of bands, even ones of whole bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        ref, ways = TaskContext.get().partitionId() << 40, detours(bins)
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                sets = [shingles(t, words) for t in part.column("text").to_pylist()]
                nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
                signed: list[bytes | None] = []
                keys, owners = [], []
                for own, node in zip(sets, nodes, strict=True):
                    if not len(own) or node in seen:
                        signed.append(None)
                        continue
                    seen.add(node)
                    signed.append(signature(own))
                    bands = np.array(band_hashes(sketch(own, bins, ways), rows), dtype=np.int64) | 1
                    whole = np.concatenate(bin_keys(own, percent)).view(np.int64)
                    keys += [bands, whole]
                    owners.append(np.full(len(bands) + len(whole), node, dtype=np.int64))
                short = [None if s is None else folded(np.frombuffer(s, dtype=np.uint64), SHORT_BITS // 64).tobytes() for s in signed]
                doc_id, t1, t2 = (part.column(c).combine_chunks() for c in ("doc_id", "t1", "t2"))
                columns = [doc_id, pa.array([len(s) for s in sets], pa.int32()), t1, t2, pa.array(short, pa.binary()), pa.array(signed, pa.binary())]
                doc = pa.StructArray.from_arrays(columns, fields=list(_DOC))
                # The rows of documents are dealt by their place.
                places = _mixed(np.arange(ref, ref + len(sets), dtype=np.uint64)).view(np.int64)
                ref += len(sets)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(nodes, pa.int64()), doc], schema=_KEYED_TYPE)
                if keys:
                    key = np.concatenate(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate(owners)), pa.nulls(len(key), _DOC)], schema=_KEYED_TYPE)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and last != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        last, end = key[-1], int(np.searchsorted(key, key[-1]))
        if end:
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held = []
        held.append(batch.slice(end))
    if held:
        yield pa.Table.from_batches(held)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of documents, and (key, node) of the keys that several nodes have.  Rows come sorted by key and node."""
    for rows in _groups(batches):
        known = rows.column("doc").is_valid()
        yield from rows.filter(known).cast(_KEYED_TYPE).combine_chunks().to_batches()
        rest = rows.filter(pa.compute.invert(known))
        key, node = rest.column("key").to_numpy(), rest.column("node").to_numpy()
        if not len(key):
            continue
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[fresh], node[fresh]
        counts = np.diff(np.append(_starts(key), len(key)))
        several = np.repeat(counts, counts) > 1
        yield pa.RecordBatch.from_arrays([pa.array(key[several]), pa.array(node[several]), pa.nulls(int(several.sum()), _DOC)], schema=_KEYED_TYPE)


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, n, component) of the buckets that hold several components: no other bucket has candidates, now or later."""
    rows = buckets.join(labels, "node")
    several = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    return rows.join(several, "bucket").select("bucket", "node", "n", "component")


def _stars(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """(u, v, nu, nv), u < v: the turn's centre of each open bucket, and its nodes of other components that are of a size for a link.

    In the first round all buckets share one order of nodes, so that copies of one text are mostly the same candidates;
    later each bucket has its own, so that two nodes that meet in several large buckets have a chance in each.
    """
    drawn = Window.partitionBy("bucket").orderBy(F.xxhash64("bucket", "node", F.lit(turn)) if turn else F.xxhash64("node"), "node")
    centres = rows.withColumn("place", F.row_number().over(drawn)).filter("place = 1")
    centres = centres.select("bucket", F.struct("node", "n").alias("y"), F.col("component").alias("cy"))
    pairs = rows.join(centres, "bucket").filter("component <> cy").select(F.struct("node", "n").alias("x"), "y")
    pairs = pairs.filter(100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.distinct().select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv"))


def _opened(percent: int, block_nodes: int):
    """(block, node, n, component, own) of the bins that hold several components; of a large bin every two parts are a block.

    ``own``: the bin is one of the node's own size class.  A pair has a bin of its larger set's class in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            key, node, n, component = (rows.column(c).to_numpy() for c in ("key", "node", "n", "component"))
            starts = _starts(key)
            counts = np.diff(np.append(starts, len(key)))
            own_class = (np.searchsorted(size_classes(percent), n, side="right") - 1) % 2 == key >> 1 & 1
            several = (np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)) & np.logical_or.reduceat(own_class, starts)
            at = [np.flatnonzero(np.repeat(several & (counts <= block_nodes), counts))]
            block = [key[at[0]]]
            for group in np.flatnonzero(several & (counts > block_nodes)).tolist():
                places = np.arange(starts[group], starts[group] + counts[group])
                parts = -(-2 * len(places) // block_nodes)
                own = (_mixed(node[places].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                for other in range(parts):
                    met = own != other
                    low, high = np.minimum(own[met], other), np.maximum(own[met], other)
                    at.append(places[met])
                    block.append(_mixed(key[places[met]].view(np.uint64) + (low * parts + high).astype(np.uint64)).view(np.int64))
            where = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block)), pa.array(node[where]), pa.array(n[where], pa.int32()), pa.array(component[where]), pa.array(own_class[where])], schema=_BLOCK_TYPE)

    return run


def _paired(percent: int):
    """(u, v, nu, nv), u < v: the pairs of a block, of different components, that their short signatures leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            block, node, n, component, own_class = (rows.column(c).to_numpy() for c in ("block", "node", "n", "component", "own"))
            bits = np.frombuffer(b"".join(rows.column("short").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
            n = n.astype(np.int64)
            us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            starts = _starts(block)
            for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(block)).tolist(), strict=True):
                for at in range(lo, hi, 64):
                    own, rest = slice(at, min(at + 64, hi)), slice(at, hi)
                    apart = np.bitwise_count(bits[own, None, :] ^ bits[None, rest, :]).sum(axis=2, dtype=np.int64)
                    may = (100 + percent) * apart <= (100 - percent) * (n[own, None] + n[None, rest])
                    x, y = np.nonzero(may & (component[own, None] != component[None, rest]) & (own_class[own, None] | own_class[None, rest]))
                    us.append(x + at)
                    vs.append(y + at)
            x, y = np.concatenate(us), np.concatenate(vs)
            sized = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[sized], y[sized]
            x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
            _, once = np.unique(np.stack([node[x], node[y]], axis=1), axis=0, return_index=True)
            x, y = x[once], y[once]
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y]), pa.array(n[x], pa.int32()), pa.array(n[y], pa.int32())], schema=_PAIR_TYPE)

    return run


def _rest(met: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, block_nodes: int) -> DataFrame:
    """(u, v, nu, nv): all pairs that agree in a whole bin, are of different components and pass the short signatures."""
    rows = met.filter("key & 1 = 0").join(nodes.select("node", "n").join(labels, "node"), "node").select("key", "node", "n", "component")
    blocks = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_opened(percent, block_nodes), "block long, node long, n int, component long, own boolean")
    signed = blocks.join(nodes.select("node", "short"), "node").select("block", "node", "n", "component", "own", "short")
    return signed.repartition("block").sortWithinPartitions("block").mapInArrow(_paired(percent), "u long, v long, nu int, nv int").distinct()


def _alike(percent: int):
    """The pairs that their signatures leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for nu, nv, a, b in zip(*[batch.column(c).to_pylist() for c in ("nu", "nv", "a", "b")], strict=True):
                one, two = (np.frombuffer(x, dtype=np.uint64) for x in (a, b))
                size = min(len(one), len(two))
                apart = int(np.bitwise_count(folded(one, size) ^ folded(two, size)).sum(dtype=np.int64))
                keep.append((100 + percent) * apart <= (100 - percent) * (nu + nv))
            yield batch.select(["u", "v", "nu", "nv"]).filter(pa.array(keep, pa.bool_()))

    return run


def _full(words: int):
    """The full sets of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                sets = [_squeezed(np.diff(shingles(t, words), prepend=np.uint64(0))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node").combine_chunks(), pa.array(sets, pa.binary())], schema=schema)

    return run


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for nu, nv, a, b in zip(*[batch.column(c).to_pylist() for c in ("nu", "nv", "a", "b")], strict=True):
                one, two = (np.cumsum(_stretched(x, "<u8", n), dtype=np.uint64) for x, n in ((a, nu), (b, nv)))
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (nu + nv - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _both(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs with what ``of`` (node, value) has for u and v, as a and b."""
    return pairs.join(of.toDF("u", "a"), "u").join(of.toDF("v", "b"), "v").select("u", "v", "nu", "nv", "a", "b")


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, text) of the needed (node, t1, t2).  A bit map of fixed size tells most other texts apart before any is shuffled."""
    word, bit = F.col("t1").bitwiseAND(MARK_WORDS - 1), F.expr("int(shiftrightunsigned(t1, 32) & 63)")
    marks = needed.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    marked = docs.withColumn("word", word).join(F.broadcast(marks), "word").withColumn("bit", bit).filter("shiftrightunsigned(bits, bit) & 1 = 1")
    return marked.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(needed, ["t1", "t2"]).select("node", "text")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The candidates (u, v, nu, nv) whose full sets are alike enough; sets are made of the texts of these nodes alone."""
    alike = cut(_both(pairs, nodes.select("node", "signature")).mapInArrow(_alike(percent), "u long, v long, nu int, nv int"))
    needed = cut(alike.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node").select("node", "t.t1", "t.t2"))
    sets = cut(_texts(docs, needed).mapInArrow(_full(words), "node long, shingles binary"))
    return cut(_both(alike, sets).mapInArrow(_compared(percent), "u long, v long"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (u, v) between nodes."""
    ends = links.join(labels.toDF("u", "cu"), "u").join(labels.toDF("v", "cv"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    renamed = components(ends).toDF("component", "now")
    return cut(labels.join(renamed, "component", "left").select("node", F.coalesce("now", "component").alias("component")))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS, rounds: int = ROUNDS, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))
    keyed = docs.mapInArrow(_keyed(words, percent, bins, rows), KEYED_SCHEMA)
    found = cut(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_met, KEYED_SCHEMA))
    documents = found.filter("doc is not null").select("node", "doc.*")
    met = found.filter("doc is null").select("key", "node")
    least = [F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min(F.struct("t1", "t2")).alias("t"), F.max("short").alias("short"), F.max("signature").alias("signature")]
    nodes = cut(documents.filter("n > 0").groupBy("node").agg(*least))
    labels = nodes.select("node", F.col("node").alias("component"))
    buckets = met.filter("key & 1 = 1").withColumnRenamed("key", "bucket").join(nodes.select("node", "n"), "node")
    for turn in range(rounds):
        buckets = cut(_open(buckets.select("bucket", "node", "n"), labels))
        labels = _relabelled(labels, _confirmed(_stars(buckets, turn, percent), docs, nodes, words, percent))
    labels = _relabelled(labels, _confirmed(_rest(met, nodes, labels, percent, block_nodes), docs, nodes, words, percent))
    named = nodes.join(labels, "node").select("node", "least", "component")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component_id")
    out = cut(documents.select("node", "doc_id", "n").join(named, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
    alone = F.col("component_id").isNull()
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), alone).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: near duplicates of all documents."""
    return near_duplicates(read_documents(spark, sf_dir))

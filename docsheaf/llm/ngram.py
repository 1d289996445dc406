"""N-gram Jaccard join: exact links of documents whose shingle sets are at least 80 % alike.

1. Shingles.  Words are lower-cased (A-Z) and hashed, five neighbours make a 64-bit shingle hash of
   which 56 bits are kept.  Documents with the same set are one node, known by a hash of the set.
2. Global order.  The shingles of many documents travel together, sorted, delta-coded and packed per
   hash range; each range finds the shingles of at least two nodes and their frequency.
   A shingle of one node can't be shared, so it only counts; the others return to their node with a
   frequency class (quarters of a power of two) in the byte above the hash: their order as numbers is
   the global order, rare ones first.
3. Prefix filter.  If none of the first ``n - ceil(0.8 n) + 1`` shingles is shared, a node has no link.
4. Trie.  Nodes that agree in one of SKETCHES minima over hashed shared shingles are joined in one
   block: their ordered sets form a path-compressed trie, and a walk over it carries, for all nodes of the
   block at once, how much they share with the path so far; branches share that vector, and a branch is
   left when the lengths that remain can't make a link.
5. The rest, exactly.  Nodes that are not connected yet may still link if they share a prefix shingle and
   are of similar size.  Each prefix shingle and size class is a block again; blocks of the same nodes are one.
   A parity signature of each set bounds every pair's difference from below; nodes that it lets pass go
   through a trie of their block.  So the sketches only save work, and every link comes from a trie.
6. Components of all links.

Blocks are bounded in nodes and in shingles.  A large block of sketches is split, and each part also gets the
block's first node, which keeps the parts of one family connected.  A large block of a prefix shingle is split
so that every two of its parts meet in one task.

Defined cases: null, empty and blank texts have no shingles and are components of their own; a
text of fewer than five words is one shingle; repeated rows are copies; rows with a null id take the
smallest id of their component, null if there is none; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsheaf.llm.components import components
from docsheaf.llm.shared import chosen_rows, cut, free_name, read_documents, row_keys, whole_text
from docsheaf.llm.tokens import slices

WORDS, PERCENT = 5, 80
#: Minima per node; nodes and shingles of one trie block; shingles of one hash range; bytes of text packed together.
SKETCHES, BLOCK_NODES, BLOCK_SHINGLES, RANGE_SHINGLES, CHUNK_BYTES = 2, 1000, 2_000_000, 2_000_000, 10_000_000
#: Tasks that take hash ranges, for each shuffle partition of the session, at most.
TASKS = 8
#: Bits of a parity signature; base of the size classes, over 1 / 0.8, so that linked sizes are in neighbouring classes.
SIGNATURE_BITS, CLASS_BASE = 1024, 1.2501
PACKED_SCHEMA = "bucket int, chunk long, n int, shingles binary, owners binary, nodes binary, doc_ids array<bigint>, sizes array<int>, keys array<bigint>"
SHARED_SCHEMA = "chunk long, refs array<bigint>, counts array<int>, shared array<bigint>, doc_ids array<bigint>, sizes array<int>, keys array<bigint>"


def needed(n):
    """The least overlap that any partner of a set of n needs: ceil(0.8 n)."""
    return (PERCENT * n + 99) // 100


def linked(overlap, n, m):
    return 100 * overlap >= PERCENT * (n + m - overlap)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes (56 bits) of a text."""
    import xxhash

    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    k = min(words, len(own))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
    n = len(own) - k + 1
    out = hashed[:n].copy()
    for j in range(1, k):
        out = _mixed(out) + hashed[j : n + j]
    return np.unique(_mixed(out) >> np.uint64(8))


def _squeezed(values: np.ndarray) -> bytes:
    """Unsigned values as byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def _stretched(data: bytes, kind: str, n: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed(buckets: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                for at in range(0, part.num_rows, 60_000):
                    own = part.slice(at, 60_000)
                    sets = [shingles(t, words) for t in own.column("text").to_pylist()]
                    sizes = np.array([len(s) for s in sets], dtype=np.int64)
                    keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64)
                    _, first = np.unique(keys, return_index=True)
                    first = np.sort(first)
                    values = np.concatenate([sets[k] for k in first.tolist()] or [np.zeros(0, dtype=np.uint64)])
                    owners = np.repeat(first.astype(np.uint16), sizes[first])
                    order = np.argsort(values, kind="stable")
                    values, owners = values[order], owners[order]
                    bucket = ((values >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    # Only the ranges that the chunk fills, and its home, have a row: never more rows than shingles.
                    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    filled = dict(zip(bucket[starts].tolist(), zip(starts.tolist(), np.append(starts, len(bucket))[1:].tolist(), strict=True), strict=True))
                    rows = []
                    home = chunk % buckets
                    for b, (lo, hi) in ({home: (0, 0)} | filled).items():
                        row = {"bucket": b, "chunk": chunk, "n": hi - lo, "shingles": b"", "owners": b"", "nodes": b"", "doc_ids": None, "sizes": None, "keys": None}
                        if hi > lo:
                            used, number = np.unique(owners[lo:hi], return_inverse=True)
                            row["shingles"] = _squeezed(np.diff(values[lo:hi], prepend=np.uint64(0)))
                            row["owners"] = _squeezed(number.astype(np.uint16))
                            row["nodes"] = used.astype("<u2").tobytes() + keys[used].astype("<u8").tobytes()
                        if b == home:
                            row |= {"doc_ids": own.column("doc_id").to_pylist(), "sizes": sizes.tolist(), "keys": keys.view(np.int64).tolist()}
                        rows.append(row)
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("shingles", pa.binary()), ("owners", pa.binary()), ("nodes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64()))]))
                    chunk += 1

    return run


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_SHARED_TYPE = pa.schema([("chunk", pa.int64()), ("refs", _LONGS), ("counts", _INTS), ("shared", _LONGS), ("doc_ids", _LONGS), ("sizes", _INTS), ("keys", _LONGS)])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash ranges of a task, which its rows come sorted by, one after the other: only one is held."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, own in groupby(rows, key=itemgetter("bucket")):
        yield from _shared(own)


def _shared(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """One hash range: the documents of its chunks, and for each node its shingles that others have too.

    A node that occurs in several chunks is known by its smallest place (chunk and row), in all ranges alike.
    """
    values, keys, refs = [], [], []
    for row in rows:
        base = row["chunk"] << 16
        if row["doc_ids"] is not None:
            yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("chunk", "doc_ids", "sizes", "keys")}], schema=_SHARED_TYPE)
        if n := row["n"]:
            table = len(row["nodes"]) // 10
            used, known = np.frombuffer(row["nodes"], dtype="<u2", count=table), np.frombuffer(row["nodes"], dtype="<u8", offset=2 * table)
            number = _stretched(row["owners"], "<u2", n)
            values.append(np.cumsum(_stretched(row["shingles"], "<u8", n), dtype=np.uint64))
            keys.append(known[number])
            refs.append(base + used[number].astype(np.int64))
    if not values:
        return
    value, key, ref = np.concatenate(values), np.concatenate(keys), np.concatenate(refs)
    values.clear(), keys.clear(), refs.clear()
    order = np.lexsort((ref, key, value))
    value, key, ref = value[order], key[order], ref[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (key[1:] != key[:-1])
    value, ref = value[fresh], ref[fresh]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    counts = np.diff(np.append(starts, len(value)))
    frequency = np.repeat(counts, counts)
    several = frequency > 1
    rank = (4 * np.log2(frequency[several])).astype(np.uint64)
    value, ref = (value[several] | (rank << np.uint64(56))).astype(np.int64), ref[several]
    order = np.lexsort((value, ref))
    value, ref = value[order], ref[order]
    chunk = ref >> 16
    edges = np.append(np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])), len(ref)) if len(ref) else np.zeros(1, dtype=np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        refs, counts = np.unique(ref[lo:hi], return_counts=True)
        row = {"chunk": int(chunk[lo]), "refs": refs, "counts": counts, "shared": value[lo:hi]}
        yield pa.RecordBatch.from_pylist([row], schema=_SHARED_TYPE)


def _regrouped(rows: pa.Table) -> pa.Table:
    """The rows that all ranges have for one chunk, by node: each node's shared shingles in global order."""
    lists = [_items(rows.column(c)) for c in ("refs", "counts", "shared")]
    ref, value = np.repeat(lists[0], lists[1]), lists[2]
    order = np.lexsort((value, ref))
    ref, value = ref[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], ref[1:] != ref[:-1]]))
    shared = pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(ref))), pa.array(value)).cast(_LONGS)
    return pa.table({"ref": pa.array(ref[starts]), "shared": shared})


def _items(column: pa.ChunkedArray) -> np.ndarray:
    """All items of a list column, in order."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])


def _minima(shared: str, sketches: int = SKETCHES) -> Column:
    """The least hash of a node's shared shingles under each of several hash functions."""

    def least(salt: int) -> Column:
        return F.array_min(F.transform(shared, lambda x: F.xxhash64(x, F.lit(salt))))

    return F.array(*[least(k) for k in range(sketches)])


def trie_links(nodes: list[int], sizes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """What is linked in a block, directly or by others: each node with the smallest one of its group.

    ``sets`` hold, in ascending order, the places of shingles in the block's order.  The trie is
    walked in lexicographic order of the sets; the stack holds one vector per branching depth: how many
    of the path's shingles each node has.
    """
    g = len(nodes)
    flat, lengths = np.concatenate(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(g), lengths)
    by_value = np.argsort(flat, kind="stable")
    holders, ends = owner[by_value], np.concatenate([[0], np.cumsum(np.bincount(flat))])
    parent = list(range(g))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def along(path: np.ndarray) -> np.ndarray:
        """How many shingles of a stretch of the path each node has."""
        lo, each = ends[path], ends[path + 1] - ends[path]
        upto = np.cumsum(each)
        at = np.arange(int(upto[-1])) + np.repeat(lo - (upto - each), each)
        return np.bincount(holders[at], minlength=g)

    def possible(overlap: np.ndarray, depth: int, k: int) -> bool:
        """Whether another node can still reach a link with set k: the lengths that remain bound it."""
        most = overlap + np.minimum(lengths[k] - depth, lengths - overlap)
        return int(linked(most, sizes, sizes[k]).sum()) > 1

    order = sorted(range(g), key=lambda k: sets[k].tolist())
    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(g, dtype=np.int64))]
    last = None
    for k in order:
        own, common = sets[k], 0
        if last is not None:
            short = min(len(own), len(last))
            apart = np.flatnonzero(own[:short] != last[:short])
            common = int(apart[0]) if len(apart) else short
        while stack[-1][0] > common:
            stack.pop()
        last = own
        depth, overlap = stack[-1]
        if common > depth:
            overlap = overlap + along(own[depth:common])
            depth = common
            stack.append((depth, overlap))
        if not possible(overlap, depth, k):
            continue
        if len(own) > depth:
            overlap = overlap + along(own[depth:])
        for other in np.flatnonzero(linked(overlap, sizes, sizes[k])).tolist():
            parent[root(k)] = root(other)
    least: dict[int, int] = {}
    for k in range(g):
        least[root(k)] = min(least.get(root(k), nodes[k]), nodes[k])
    return [(nodes[k], least[root(k)]) for k in range(g) if nodes[k] != least[root(k)]]


def _block_links(rows: pa.Table) -> pa.Table:
    shared = rows.column("shared").combine_chunks()
    shared = pa.concat_arrays(shared.chunks) if isinstance(shared, pa.ChunkedArray) else shared
    edges = np.concatenate([[0], np.cumsum(shared.value_lengths().to_numpy())])
    _, places = np.unique(shared.flatten().to_numpy(), return_inverse=True)
    links = trie_links(rows.column("node").to_pylist(), rows.column("n").to_numpy().astype(np.int64), [places[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with a signature: for each of SIGNATURE_BITS classes of shingles, whether the node has an odd number of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            shared = part.column("shared")
            row = np.repeat(np.arange(part.num_rows), shared.value_lengths().to_numpy())
            bit = shared.flatten().to_numpy() & (SIGNATURE_BITS - 1)
            odd = np.bincount(row * SIGNATURE_BITS + bit, minlength=part.num_rows * SIGNATURE_BITS) & 1
            packed = np.packbits(odd.astype(bool).reshape(part.num_rows, SIGNATURE_BITS), axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in packed], pa.binary())], names=[*part.schema.names, "signature"])


def _blocks(nodes: DataFrame, block_nodes: int) -> DataFrame:
    """(node, block): for every minimum that two nodes have, its block, split where it is large."""
    keys = nodes.select("node", F.size("shared").alias("len"), F.posexplode("minima").alias("sketch", "least"))
    parts = F.ceil(F.greatest(F.col("c") / block_nodes, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    sized = keys.groupBy("sketch", "least").agg(F.count("*").alias("c"), F.sum("len").alias("weight"), F.min("node").alias("first")).filter("c > 1").select("sketch", "least", "first", parts.alias("parts"))
    part = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    return keys.join(sized, ["sketch", "least"]).select("node", F.explode(part).alias("part"), "sketch", "least").select("node", F.xxhash64("sketch", "least", "part").alias("block"))


def _prefix_blocks(nodes: DataFrame, labels: DataFrame, block_nodes: int) -> DataFrame:
    """(node, block): nodes of similar size that share a prefix shingle, where they are of several components.

    Shingles that the same nodes have in their prefixes make one block.  Of a large block every two parts meet.
    """
    size_class = F.floor(F.log("n") / F.lit(float(np.log(CLASS_BASE)))).cast("int")
    rows = nodes.join(labels, "node").select("node", "component", F.size("shared").alias("len"), size_class.alias("k"), F.explode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("shingle"))
    rows = rows.select("node", "component", "len", F.explode(F.array(F.xxhash64("shingle", "k"), F.xxhash64("shingle", F.col("k") + 1))).alias("slot"))
    holders = [F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")]
    per = rows.groupBy("slot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c"), F.sum("len").alias("weight"), *holders).filter("low <> high")
    over = F.greatest(F.col("c") / block_nodes, F.col("weight") / BLOCK_SHINGLES)
    parts = F.when(over <= 1, 1).otherwise(F.ceil(2 * over)).cast("int")
    slots = per.groupBy("c", "x1", "x2").agg(F.min("slot").alias("slot"), F.min("weight").alias("weight")).select("slot", parts.alias("parts"))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
    met = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (F.col("parts") == 1) | (j != own))
    return rows.join(slots, "slot").select("node", "slot", own.alias("own"), F.explode(met).alias("other")).select("node", F.xxhash64("slot", F.least("own", "other"), F.greatest("own", "other")).alias("block"))


def _passing(rows: pa.Table) -> pa.Table:
    """The nodes of a block that may have a link with one of another component: their signatures do not rule it out.

    The signatures' distance is at most the symmetric difference of the shared shingles; shingles of one node alone add
    to that, and a link allows a ninth of both sizes.
    """
    g = rows.num_rows
    bits = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint64).reshape(g, -1)
    n, component = rows.column("n").to_numpy().astype(np.int64), rows.column("component").to_numpy()
    alone = n - rows.column("len").to_numpy()
    passing = np.zeros(g, dtype=bool)
    for at in range(0, g, 64):
        own = slice(at, at + 64)
        apart = np.bitwise_count(bits[own, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64) + alone[own, None] + alone[None, :]
        may = (100 + PERCENT) * apart <= (100 - PERCENT) * (n[own, None] + n[None, :])
        passing[own] = (may & (component[own, None] != component[None, :])).any(axis=1)
    return pa.table({"node": rows.column("node").filter(passing), "block": rows.column("block").filter(passing)})


def near_duplicates(docs: DataFrame, words: int = WORDS, sketches: int = SKETCHES, block_nodes: int = BLOCK_NODES, range_shingles: int = RANGE_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length(whole_text("text"))).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, -(-size // (7 * range_shingles)))
    packed = docs.mapInArrow(_packed(buckets, words), PACKED_SCHEMA)
    # The number of tasks is a matter of the cluster; each takes its ranges in order.
    tasks = min(buckets, TASKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = packed.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    found = cut(dealt.mapInArrow(_ranges, SHARED_SCHEMA))
    zipped = F.posexplode(F.arrays_zip("doc_ids", "sizes", "keys")).alias("at", "d")
    documents = found.filter("doc_ids is not null").select("chunk", zipped).select((F.shiftleft("chunk", 16) + F.col("at")).alias("ref"), F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").alias("n"), F.col("d.keys").alias("key"))
    sets = documents.filter("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("least"), F.min("ref").alias("node"))
    own = found.filter("refs is not null").select("chunk", "refs", "counts", "shared").groupBy("chunk").applyInArrow(_regrouped, "ref long, shared array<bigint>")
    need = F.floor((PERCENT * F.col("n") + 99) / 100).cast("int")
    nodes = own.join(sets, own["ref"] == sets["node"]).select("node", "n", "shared", (F.size("shared") - need + 1).alias("prefix")).filter("prefix > 0")
    nodes = cut(nodes.withColumn("minima", _minima("shared", sketches)).mapInArrow(_signed, "node long, n int, shared array<bigint>, prefix int, minima array<bigint>, signature binary"))
    own_sets = nodes.select("node", "n", "shared")

    def links_of(blocks: DataFrame) -> DataFrame:
        return cut(blocks.join(own_sets, "node").groupBy("block").applyInArrow(_block_links, "u long, v long"))

    labels = _relabelled(nodes.select("node", F.col("node").alias("component")), links_of(_blocks(nodes, block_nodes)))
    members = _prefix_blocks(nodes, labels, block_nodes).join(nodes.select("node", "n", F.size("shared").alias("len"), "signature"), "node").join(labels, "node")
    rest = cut(members.groupBy("block").applyInArrow(_passing, "node long, block long"))
    if not rest.isEmpty():
        more = links_of(rest).join(labels.toDF("u", "cu"), "u").join(labels.toDF("v", "cv"), "v")
        labels = _relabelled(labels, more.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    named = sets.join(labels, "node", "left").select("key", "n", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(smallest, "component").select("key", "n", "component_id"))
    return documents.join(named, ["key", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (u, v) between components."""
    found = components(links).select(F.col("node").alias("was"), F.col("component").alias("now"))
    return cut(labels.join(found, labels["component"] == found["was"], "left").select("node", F.coalesce("now", "component").alias("component")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: links all documents."""
    return near_duplicates(read_documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that with the smallest id, null last; so do all rows without words.

    The join knows a row by a hash of its id and text, so rows may share an id or have none.  Different rows that share
    that hash, which a second hash tells, all stay.
    """
    k1, k2 = free_name(docs, "k1"), free_name(docs, "k2")
    keys = dict(zip((k1, k2), row_keys(docs["doc_id"], docs["text"]), strict=True))
    known = docs.select(docs["doc_id"].alias("id"), *[k.alias(n) for n, k in keys.items()]).groupBy(k1, k2).agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    found = near_duplicates(docs.select(keys[k1].alias("doc_id"), "text"))
    rows = found.groupBy(F.col("doc_id").alias(k1)).agg(F.min("component_id").alias("component_id"), F.min("n_shingles").alias("n")).join(known, k1)
    alike = free_name(rows, "alike")
    rows = rows.withColumn(alike, F.count("*").over(Window.partitionBy(k1)))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", k1, k2, "copies")).alias("first")
    kept = rows.filter((F.col("n") > 0) & (F.col(alike) == 1)).groupBy("component_id").agg(first).select(f"first.{k1}", f"first.{k2}", "first.copies")
    blank = rows.filter((F.col("n") == 0) | (F.col(alike) > 1)).select(k1, k2, F.lit(1).cast("long").alias("copies"))
    return chosen_rows(docs, keys, kept.unionAll(blank))

"""Collocations by stripes: each prefix of words keys a counter of the words that follow it.

A task turns some megabytes of text into stripes (language, prefix, next words, counts).  Stripes are dealt out by
prefix, sorted, and merged element by element as they stream by, so a task holds some hundred thousand entries and
one stripe at most.  The merged stripes of one-word prefixes give both the counts of their extensions (pairs) and, as the
total of a stripe with the pieces' ends in it, the counts of words.  The stripes of longer prefixes give the longer phrases,
and their maxima tell which prefix a longer phrase subsumes.

A phrase can't be more frequent than what it holds.  So stripes of two words and more are only made of windows whose
first and last parts may be frequent, told by a bit map of fixed size (BITMAP_BITS): a bit that is set in vain costs an
entry, which the exact counts then drop.  A prefix that very many windows begin with is known from a bounded sample of
texts, and its stripe is dealt out in PARTS by next word; the sample only spreads work, no count depends on it.

Scores: a cut of a phrase of frequency a into parts of frequencies l and r has floor(1000000 * a * a / (l * r)), in decimals of 38
digits (exact up to 10 ** 13 occurrences); the lowest cut counts, ties go to the shortest first part.

Defined cases: a null text is empty; a null language is ``und``, and joins rows that say so; pieces without words give
nothing; a language without candidates has no row; repeated rows count as often as they stand; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsheaf.llm.shared import cut, read_documents
from docsheaf.llm.tokens import slices

#: Words of the longest phrase, least frequency, per cent of a phrase's frequency at which a longer one subsumes it, phrases per language.
MAX_WORDS, MIN_COUNT, SUBSUMED, TOP = 3, 10, 50, 2000
#: UTF-8 bytes of text that are counted together; stripe entries that are merged together.
CHUNK_BYTES, MERGED_ENTRIES = 10_000_000, 600_000
#: Texts in the sample; a prefix of at least 1 / SHARE of its windows is dealt out in PARTS.
SAMPLE, SHARE, PARTS = 2000, 1000, 32
#: Places in the bit map of frequent phrases: 16 MB, whatever the corpus.
BITMAP_BITS = 27
BREAKS = r"[.,;:!?\n\x0b\x0c\r]"
STRIPE_SCHEMA = "lang string, prefix string, part int, nexts array<string>, counts array<bigint>"
MERGED_SCHEMA = "lang string, kind string, phrase string, f bigint, slot bigint"
_STRIPE = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()), ("nexts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_MERGED = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("phrase", pa.string()), ("f", pa.int64()), ("slot", pa.int64())])


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _slots(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """Places in the bit map of phrases, whose k-th words have the hashes hashes[k]."""
    import xxhash

    out = np.full(len(hashes[0]), xxhash.xxh3_64_intdigest(lang.encode()), dtype=np.uint64)
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return (out >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _words(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, int]:
    """Distinct words of some texts, the words of all pieces in order as numbers, and the number that ends a piece."""
    texts = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    texts = pc.replace_substring(pc.replace_substring_regex(texts, BREAKS, " \n "), "\t", " ")
    texts = pc.binary_join_element_wise(texts, pa.scalar(" \n", pa.large_string()), pa.scalar("", pa.large_string()))
    flat = pc.list_flatten(pc.split_pattern(texts, " ")).combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    coded = pc.dictionary_encode(flat)
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    end = pc.index(words, pa.scalar("\n", pa.large_string())).as_py()
    empty = pc.index(words, pa.scalar("", pa.large_string())).as_py()
    return words, codes[codes != empty] if empty >= 0 else codes, end


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


def _stripes(level: int, heavy: set[tuple[str, str]], bitmap=None):
    """Stripes of prefixes of ``level`` words.  Those of one word also count the ends of pieces, as next word ''."""

    def of(lang: str, texts: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        words, codes, end = _words(texts)
        n, count = len(words), len(codes) - level
        if count <= 0:
            return
        at = [codes[k : k + count] for k in range(level + 1)]
        good = at[0] != end
        for w in at[1:] if level > 1 else ():
            good &= w != end
        hashes = None
        if bitmap is not None:
            bits = np.frombuffer(bitmap.value, dtype=np.uint8)
            hashes = _word_hashes(words.cast(pa.large_binary()).to_pylist())
            known = np.zeros(len(codes) - level + 1, dtype=bool)
            slots = _slots(lang, [hashes[codes[k : k + len(known)]] for k in range(level)])
            known = (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
            good &= known[:-1] & known[1:]
        chosen = np.flatnonzero(good)
        prefix, parts = at[0][chosen], [at[0][chosen]]
        for k in range(1, level):
            distinct, prefix = np.unique(prefix * n + at[k][chosen], return_inverse=True)
            parts = [(p[distinct // n] if k > 1 else distinct // n) for p in parts] + [distinct % n]
        keys, counts = _grouped(prefix * n + at[level][chosen])
        if not len(keys):
            return
        prefix, following = keys // n, keys % n
        names = words.take(pa.array(following)).cast(pa.string())
        if level == 1:
            names = pc.if_else(pa.array(following == end), "", names)
            heads = [words]
        else:
            heads = [words.take(pa.array(p)) for p in parts]
        fresh = np.concatenate([[True], prefix[1:] != prefix[:-1]])
        starts = np.flatnonzero(fresh)
        texts_of = [h.take(pa.array(prefix[starts])) for h in heads]
        texts_of = texts_of[0] if level == 1 else pc.binary_join_element_wise(*texts_of, pa.scalar(" ", pa.large_string()))
        part = np.zeros(len(keys), dtype=np.int64)
        split = [k for k, p in enumerate(texts_of.to_pylist()) if (lang, p) in heavy] if heavy else []
        if split:
            bounds = np.append(starts, len(keys))
            own = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in split])
            part[own] = (_word_hashes(names.take(pa.array(own)).cast(pa.binary()).to_pylist()) % np.uint64(PARTS)).astype(np.int64)
            order = np.lexsort((part, prefix))
            prefix, part, counts, names = prefix[order], part[order], counts[order], names.take(pa.array(order))
            row = np.cumsum(fresh) - 1
            starts = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])]))
            texts_of = texts_of.take(pa.array(row[starts]))  # sorted by prefix as before, so row still fits
        offsets = pa.array(np.append(starts, len(keys)), pa.int32())
        columns = [pa.array([lang] * len(starts), pa.string()), texts_of.cast(pa.string()), pa.array(part[starts], pa.int32()), pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
        yield from pa.table(columns, schema=_STRIPE).combine_chunks().to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in slices(batch, "text", CHUNK_BYTES):
                langs = chunk.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    yield from of(lang, chunk.column("text").filter(pc.equal(langs, lang)))

    return run


def _merge(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Stripes, sorted by key, of which neighbours with one key become one: keys, first entry of each, lengths, next words, counts."""
    changed = np.zeros(rows.num_rows, dtype=bool)
    changed[0] = True
    for c in ("lang", "prefix", "part"):
        column = rows.column(c).combine_chunks()
        changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    lists = rows.column("nexts").combine_chunks()
    group = np.repeat(np.cumsum(changed) - 1, pc.list_value_length(lists).to_numpy())
    coded = pc.dictionary_encode(lists.flatten())
    size = max(1, len(coded.dictionary))
    keys = group * size + coded.indices.to_numpy()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.add.reduceat(rows.column("counts").combine_chunks().flatten().to_numpy()[order], starts)
    keys = keys[starts]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] // size != keys[:-1] // size]))
    return rows.select(["lang", "prefix", "part"]).filter(pa.array(changed)), firsts, np.diff(np.append(firsts, len(keys))), coded.dictionary.take(pa.array(keys % size)), counts


def _merged(level: int, min_count: int, heavy: set[tuple[str, str]]):
    """What the stripes of a level tell.  Kinds: ``phrase`` (an extension of at least min_count), ``longest`` (the greatest of a stripe), and on
    level 1 ``word`` (a stripe's total) and ``rest`` (of all words that are too rare, in a heap)."""

    def told(keys: pa.Table, firsts: np.ndarray, lengths: np.ndarray, nexts: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        out = []
        langs, prefixes = keys.column("lang").combine_chunks(), keys.column("prefix").combine_chunks()
        if level == 1:
            totals = np.add.reduceat(counts, firsts)
            split = np.array([(g, p) in heavy for g, p in zip(langs.to_pylist(), prefixes.to_pylist(), strict=True)]) if heavy else np.zeros(len(totals), dtype=bool)
            many = (totals >= min_count) | split
            out.append((langs.filter(pa.array(many)), "word", prefixes.filter(pa.array(many)), totals[many], None))
            few, sums = {}, totals[~many].tolist()
            for g, f in zip(langs.filter(pa.array(~many)).to_pylist(), sums, strict=True):
                few[g] = few.get(g, 0) + f
            out.append((pa.array(list(few), pa.string()), "rest", pa.nulls(len(few), pa.string()), np.array(list(few.values()), dtype=np.int64), None))
        frequent = counts >= min_count
        if level == 1:
            frequent &= pc.not_equal(nexts, "").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(firsts)), lengths)[frequent]
        own = [langs.take(pa.array(row)), prefixes.take(pa.array(row)), nexts.filter(pa.array(frequent))]
        phrases = pc.binary_join_element_wise(own[1], own[2], " ")
        slots = np.zeros(len(row), dtype=np.int64)
        own_langs, words = np.array(own[0].to_pylist(), dtype=object), [p.encode().split(b" ") for p in phrases.to_pylist()]
        for lang in set(own_langs.tolist()):
            at = np.flatnonzero(own_langs == lang)
            slots[at] = _slots(lang, [_word_hashes([words[i][k] for i in at.tolist()]) for k in range(level + 1)])
        out.append((own[0], "phrase", phrases, counts[frequent], slots))
        if level > 1:
            most = np.maximum.reduceat(counts, firsts)
            long = most >= min_count
            out.append((langs.filter(pa.array(long)), "longest", prefixes.filter(pa.array(long)), most[long], None))
        tables = [pa.table([a, pa.array([kind] * len(f), pa.string()), p, pa.array(f, pa.int64()), pa.nulls(len(f), pa.int64()) if s is None else pa.array(s, pa.int64())], schema=_MERGED) for a, kind, p, f, s in out]
        return pa.concat_tables(tables).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, entries, most = [], 0, MERGED_ENTRIES
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]).cast(_STRIPE))
            entries += len(batch.column("nexts").flatten())
            if entries < most:
                continue
            keys, firsts, lengths, nexts, counts = _merge(pa.concat_tables(waiting))
            last = int(firsts[-1])
            if len(firsts) > 1:
                yield from told(keys[:-1], firsts[:-1], lengths[:-1], nexts[:last], counts[:last]).to_batches()
            # The last stripe may go on; merged, it waits for the rest.
            tail = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (nexts[last:], pa.array(counts[last:], pa.int64()))]
            waiting, entries = [pa.table([*keys[-1:].columns, *tail], schema=_STRIPE)], len(counts) - last
            most = max(MERGED_ENTRIES, 2 * entries)
        if waiting:
            yield from told(*_merge(pa.concat_tables(waiting))).to_batches()

    return run


def _heavy(texts: DataFrame) -> dict[int, set[tuple[str, str]]]:
    """By number of words the prefixes (lang, words) that begin at least 1 / SHARE of a sample's windows: at most SHARE of them."""
    rows = texts.count()
    sample = texts.sample(min(1.0, 2 * SAMPLE / rows), seed=1).limit(SAMPLE) if rows > SAMPLE else texts
    entries = sample.mapInArrow(_stripes(1, set()), STRIPE_SCHEMA).select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e")).select("lang", "prefix", F.col("e.nexts").alias("next"), F.col("e.counts").alias("c"))
    out = {}
    for words, keys in ((1, ["prefix"]), (2, ["prefix", "next"])):
        own = entries if words == 1 else entries.filter("next <> ''")
        counted = own.groupBy("lang", F.concat_ws(" ", *keys).alias("phrase")).agg(F.sum("c").alias("c"))
        total = own.agg(F.sum("c").alias("c")).first()["c"] or 0
        out[words] = {(r["lang"], r["phrase"]) for r in counted.filter(F.col("c") * SHARE >= max(total, SHARE)).collect()}
    return out


def _bitmap(spark: SparkSession, frequent: DataFrame):
    """A broadcast bit map of fixed size with the slots of frequent phrases."""
    place = F.col("slot") + 1  # Spark's bit maps count from 1
    blocks = frequent.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray(1 << (BITMAP_BITS - 3))
    size = 4096
    for r in blocks.collect():  # at most the map's own size
        at = (r["block"] - 1) * size
        own = bytes(r["bits"])[: len(out) - at]
        out[at : at + len(own)] = own
    return spark.sparkContext.broadcast(bytes(out))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases of 2 to ``max_words`` words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].alias("text"))
    heavy, bitmap, found = _heavy(texts), None, {}
    for level in range(1, max_words):
        own = heavy.get(level, set())
        stripes = texts.mapInArrow(_stripes(level, own, bitmap), STRIPE_SCHEMA)
        found[level] = cut(stripes.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part").mapInArrow(_merged(level, min_count, own), MERGED_SCHEMA))
        if level + 1 < max_words:
            bitmap = _bitmap(spark, found[level].filter("kind = 'phrase'"))
    words = found[1].filter("kind in ('word', 'rest')")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    counts = {1: words.filter("kind = 'word'").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)}
    counts |= {level + 1: rows.filter("kind = 'phrase'").select("lang", "phrase", "f") for level, rows in found.items()}
    parts = []
    for size in range(2, max_words + 1):
        rows = counts[size].withColumnRenamed("f", "a")
        for k in range(1, size):
            left, right = counts[k].toDF("lang", "head", f"l{k}"), counts[size - k].toDF("lang", "tail", f"r{k}")
            rows = rows.withColumn("head", F.substring_index("phrase", " ", k)).withColumn("tail", F.substring_index("phrase", " ", k - size)).join(left, ["lang", "head"]).join(right, ["lang", "tail"]).drop("head", "tail")
        cuts = [F.struct(_cut_score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
        parts.append(rows.select("lang", "phrase", "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut")))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    if max_words > 2:
        scored = _without_subsumed(scored, found, counts, max_words, subsumed)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def _cut_score(k: int) -> Column:
    """floor(1000000 * a * a / (l * r)) of the cut after k words, in whole decimals."""
    a, left, right = (f"cast({c} as decimal(14,0))" for c in ("a", f"l{k}", f"r{k}"))
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({a} * {a})) div ({left} * {right})")


def _without_subsumed(scored: DataFrame, found: dict[int, DataFrame], counts: dict[int, DataFrame], max_words: int, subsumed: int) -> DataFrame:
    """The phrases that no longer candidate holds at ``subsumed`` per cent of their frequency or more.

    The longer candidates that extend a phrase to the right are the entries of its stripe, whose maximum is known; for the
    other places the maximum is taken over the longer phrases.
    """
    longer = None
    for size in range(3, max_words + 1):
        inner = [found[size - 1].filter("kind = 'longest'").select("lang", "phrase", "f")]
        places = [(at, n) for n in range(2, size) for at in range(size - n + 1) if (at, n) != (0, size - 1)]
        words = F.split("phrase", " ")
        pieces = F.explode(F.array(*[F.array_join(F.slice(words, at + 1, n), " ") for at, n in places]))
        inner.append(counts[size].select("lang", pieces.alias("phrase"), "f"))
        for rows in inner:
            longer = rows if longer is None else longer.unionByName(rows)
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = F.col("most").isNull() | (100 * F.col("most").cast("decimal(20,0)") < subsumed * F.col("a").cast("decimal(20,0)"))
    return scored.join(most, ["lang", "phrase"], "left").filter(kept).drop("most")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the collocations of all documents."""
    return collocations(read_documents(spark, sf_dir))


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
o AS (SELECT lang, id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w),
s AS (SELECT lang, x, lead(x) OVER v AS y, lead(x, 2) OVER v AS z FROM o WINDOW v AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, x AS phrase FROM s UNION ALL SELECT lang, x || ' ' || y FROM s WHERE y IS NOT NULL UNION ALL SELECT lang, x || ' ' || y || ' ' || z FROM s WHERE z IS NOT NULL),
f AS (SELECT lang, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE NOT contains(phrase, ' ') GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE f >= 10 AND contains(phrase, ' ')),
h AS (SELECT lang, phrase, a, 1 AS j, ws[1] AS head, array_to_string(ws[2:], ' ') AS tail FROM c
      UNION ALL SELECT lang, phrase, a, 2, array_to_string(ws[1:2], ' '), ws[3] FROM c WHERE len(ws) = 3),
cuts AS (SELECT h.lang, h.phrase, h.a, h.j, x.f AS l, y.f AS r, 1000000 * h.a * h.a // (x.f * y.f) AS score
         FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h.head JOIN f y ON y.lang = h.lang AND y.phrase = h.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM c WHERE len(ws) = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.part = b.phrase WHERE o.most IS NULL OR 100 * o.most < 50 * b.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n ON n.lang = kept.lang
QUALIFY rank <= 2000
"""

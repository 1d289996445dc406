import random

import numpy as np
import pytest

from docsheaf.llm import minhash
from tests.llm.test_ngram import words


def brute(rows, k=3, percent=85):
    """(n_shingles, component) of each row: all pairs of distinct sets."""
    sets = []
    for _, text in rows:
        own = words(text)
        size = min(k, len(own))
        sets.append(frozenset(tuple(own[i : i + size]) for i in range(len(own) - size + 1)) if own else frozenset())
    label = {s: s for s in sets if s}

    def root(s):
        while label[s] != s:
            s = label[s]
        return s

    every = list(label)
    for i, s in enumerate(every):
        for t in every[:i]:
            if 100 * len(s & t) >= percent * len(s | t) and root(s) != root(t):
                label[root(s)] = root(t)
    least = {}
    for (doc, _), s in zip(rows, sets, strict=True):
        if s and doc is not None:
            least[root(s)] = min(least.get(root(s), doc), doc)
    return [(doc, len(s), least.get(root(s)) if s else doc) for (doc, _), s in zip(rows, sets, strict=True)]


def corpus(seed, families=25, copies=12):
    rng = random.Random(seed)
    shared = [f"common{k}" for k in range(30)]
    texts = []
    for _ in range(families):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([2, 8, 40, 120, 400]))]
        if rng.random() < 0.3:
            base = shared + base
        for _ in range(rng.randint(1, copies)):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(new) // 25))):
                new[rng.randrange(len(new))] = f"x{rng.randint(0, 10**6)}"
            texts += [" ".join(new)] * rng.choice([1, 1, 2])
    texts += ["", None, " \t", "one", "ONE", "two words", "É", "é", "a b c " * 300]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, node string, k1 int").repartition(3)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    want = brute(rows)
    assert [(d, got[d]["n_shingles"]) for d, _ in rows] == [(d, n) for d, n, _ in want]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    exact = {d: c for d, _, c in want}
    # Every link is exact, so no component joins two of the exact ones.
    assert all(exact[d] == exact[r["component_id"]] for d, r in got.items())
    right = sum(got[d]["component_id"] == c for d, c in exact.items())
    assert right >= 0.99 * len(rows), (right, len(rows))


def near_the_bound(seed, groups=12, size=12):
    """Texts that differ from one another by about as much as links allow, some in chains."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(rng.choice([9, 14, 30, 60, 150, 400, 1500]))]
        for _ in range(size):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(new) // 30))):
                new[rng.randrange(len(new))] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(new))
            base = new if rng.random() < 0.4 else base
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "sketch"), [(1, {"bins": 8, "rows": 8}), (2, {"bins": 8, "rows": 8, "block_nodes": 4}), (3, {"rounds": 0}), (4, {})])
def test_no_link_is_lost_whatever_the_sketches(spark, seed, sketch):
    rows = near_the_bound(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, **sketch).collect())
    want = brute(rows)
    assert len({c for _, _, c in want}) > 12
    assert got == sorted(want)


@pytest.mark.parametrize("percent", [60, 85, 97])
def test_linked_sets_share_a_key_of_a_whole_bin(percent):
    rng, met = np.random.default_rng(5), 0
    for _ in range(400):
        pool = np.unique(rng.integers(0, 1 << 56, int(np.exp(rng.uniform(0.7, 6.5))) + 1, dtype=np.uint64))
        a, b = (np.sort(rng.permutation(pool)[: max(1, len(pool) - int(rng.integers(0, 2 + len(pool) * (100 - percent) // 150)))]) for _ in range(2))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common):
            met += 1
            assert len(np.intersect1d(*[np.concatenate(minhash.bin_keys(x, percent)) for x in (a, b)]))
            assert minhash.folded(np.frombuffer(minhash.signature(a), dtype=np.uint64), 8).size == 8
    assert met > 100


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a b c d"), (None, "A b c d"), (None, "q r s t"), (4, "q r s t"), (4, "m n o p"), (9, "M n o p"), (None, None), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    want = [(None, 2, None, True), (None, 2, None, True), (None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (None, 0, None, True), (3, 0, 3, True), (3, 0, 3, True)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_bins_agree_as_often_as_sets_do():
    rng, ways = np.random.default_rng(3), minhash.detours(128)
    for size, shared in ((30, 26), (400, 340), (5000, 4000)):
        same = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 56, 2 * size - shared, dtype=np.uint64))
            a, b = np.sort(rng.permutation(pool)[:size]), None
            b = np.sort(np.concatenate([rng.permutation(a)[:shared], np.setdiff1d(pool, a)]))
            same.append((minhash.sketch(a, 128, ways) == minhash.sketch(b, 128, ways)).mean())
        assert abs(np.mean(same) - shared / (2 * size - shared)) < 0.05


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.query(spark, sf_dir).collect())
    assert got == sorted(brute(rows))

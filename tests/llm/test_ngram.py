import random

import numpy as np
import pytest

from docsheaf.llm import ngram
from docsheaf.llm.components import components


def words(text):
    return [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]


def brute(rows):
    sets = []
    for _, text in rows:
        own = words(text)
        k = min(5, len(own))
        sets.append({tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set())
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            t = sets[j]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((r[0] if r[0] is not None else -1, len(s), least.get(root(i), -1)) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def families(seed, n_families=12, copies=25, length=60):
    """Families of texts, each made from another member by a few edits, so links form chains."""
    rng = random.Random(seed)
    passage = " ".join(f"common{k}" for k in range(20))
    rows = []
    for f in range(n_families):
        members = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(4, length))]]
        for _ in range(rng.randint(0, copies)):
            new = list(rng.choice(members))
            for _ in range(rng.randint(0, 3)):
                new[rng.randrange(len(new))] = f"x{rng.randint(0, 10**6)}"
            members.append(new)
        rows += [(passage + " " if rng.random() < 0.3 else "") + " ".join(m) for m in members]
    rows += ["", None, " \n", "one", "ONE", "two words", "Two\twords", "É", "é", "z " * 500]
    rng.shuffle(rows)
    return [(None if k == 3 else k % 97 if k > 150 else k + 1000, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("sketches,block_nodes,range_shingles", [(4, 1000, 2_000_000), (1, 3, 300)])
def test_against_brute_force(spark, sketches, block_nodes, range_shingles):
    rows = families(sketches)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = ngram.near_duplicates(docs, sketches=sketches, block_nodes=block_nodes, range_shingles=range_shingles).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got)
    assert got == brute(rows)


def test_query_and_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram.query(spark, sf_dir).collect())
    assert got == brute(rows)
    assert ngram.near_duplicates(docs.limit(0)).count() == 0


def test_trie_links_span_all_links():
    rng = random.Random(2)
    for _ in range(40):
        base = [sorted(rng.sample(range(60), rng.randint(5, 40))) for _ in range(4)]
        sets = [np.array(sorted(set(rng.choice(base)) ^ set(rng.sample(range(60), rng.randint(0, 3))))) for _ in range(15)]
        sizes = np.array([len(s) + rng.randint(0, 2) for s in sets])
        links = ngram.trie_links(list(range(15)), sizes, sets)
        label = list(range(15))

        def join(a, b, label=label):
            x, y = label[a], label[b]
            label[:] = [y if z == x else z for z in label]

        want = list(range(15))
        for i in range(15):
            for j in range(i):
                if ngram.linked(len(set(sets[i]) & set(sets[j])), sizes[i], sizes[j]):
                    x, y = want[i], want[j]
                    want = [y if z == x else z for z in want]
        for a, b in links:
            join(a, b)
        assert [[i for i in range(15) if label[i] == label[k]] for k in range(15)] == [[i for i in range(15) if want[i] == want[k]] for k in range(15)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: root(a) for a in parent}

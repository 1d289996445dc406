import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docsheaf.llm import repeats


def brute(words, least=12):
    """Every maximal stretch of each period, kept where no smaller period fits it."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            stop = start
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            length = stop - start + q
            if stop > start and length >= max(least, 2 * q):
                own = words[start : start + length]
                if not any(all(own[i] == own[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.add((start, length, q))
            start = stop + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs))


def sample(rng):
    words = []
    for _ in range(rng.randint(1, 6)):
        block = [f"w{rng.randint(0, rng.choice([1, 2, 5, 50]))}" for _ in range(rng.randint(1, 9))]
        times = rng.choice([1, 1, 2, 3, 7])
        words += (block * times)[: rng.randint(1, len(block) * times)]
    return words


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(400):
        words = sample(rng)
        assert [tuple(r) for r in repeats.runs_of(words, least).tolist()] == brute(words, least)


def test_fibonacci_and_unary():
    a, b = "0", "01"
    while len(b) < 300:
        a, b = b, b + a
    assert [tuple(r) for r in repeats.runs_of(list(b), 2).tolist()] == brute(list(b), 2)
    assert repeats.runs_of(["x"] * 5000).tolist() == [[0, 5000, 1]]
    assert repeats.runs_of(["x"] * 11).tolist() == []


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, "\t".join(sample(rng)) + rng.choice(["", " \n", "\x0b\x0c"])) for k in range(120)]
    rows += [(None, " ".join(["a", "b"] * 9)), (500, None), (501, ""), (502, " \r\n"), (503, "é é " * 20), (503, "é é " * 20), (-4, "x " * 30), (504, "one")]
    docs = spark.createDataFrame([(d, t, [1], "c") for d, t in rows], "doc_id long, text string, RUNS array<int>, collapsed string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.query(spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        words = rewritten(d, [w.decode() for w in (t or "").encode().split()])
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((d, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 20


def test_keeps_other_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 8, "keep", 3)], "doc_id long, text string, note string, Collapsed int")
    found = repeats.periodic_runs(docs)
    row = found.first()
    assert (row["note"], row["collapsed"], row["runs"][0]["period"]) == ("keep", "a b", 2)
    assert repeats.periodic_runs(docs.limit(0)).count() == 0
    assert repeats.periodic_runs(docs, F.col("note")).first()["collapsed"] == "keep"

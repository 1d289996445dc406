import random
import re
from collections import Counter

import pytest

from docsheaf.llm import phrases


def brute(rows, max_words=3, least=10, subsumed=50, top=2000):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    own[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * c >= subsumed * a and inside(q) for q, c in candidates.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    fixed = [["new", "york", "city"], ["San", "Jose"], ["é", "É", "ß"], [" x", " "], ["a", "b", "a", "b"], ["#", "\x00", "\x01"]]
    rows = []
    for _ in range(220):
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts += rng.choice(fixed) if rng.random() < 0.4 else [rng.choice("abcdefghij") + str(int(rng.random() ** 3 * 12))]
            if rng.random() < 0.2:
                parts.append(rng.choice(". , ; : ! ? \n \r \x0b \x0c".split(" ") + ["?!"]))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([" ", "  ", "\t"]).join(parts)))
    return rows + [("en", None), ("fr", ""), ("fr", " .. "), (None, "q"), ("en", "the end " * 400), ("es", ".,;")]


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_against_brute_force(spark, max_words):
    rows = corpus(max_words)
    docs = spark.createDataFrame([(g, t, 1, "p") for g, t in rows], "lang string, text string, n int, prefix string").repartition(5)
    got = phrases.collocations(docs, max_words=max_words).collect()
    assert sorted(map(tuple, got)) == brute(rows, max_words)
    got = phrases.collocations(docs, max_words=max_words, min_count=3, top=7).collect()
    assert sorted(map(tuple, got)) == brute(rows, max_words, least=3, top=7)


def test_small_pieces_of_work(spark, monkeypatch):
    """Stripes that are split and that are merged in many steps give the same."""
    rows = corpus(9)
    for name, value in (("CHUNK_BYTES", 400), ("MERGED_ENTRIES", 10)):
        monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    texts = docs.selectExpr("coalesce(lang, 'und') as lang", "text")
    heavy = phrases._heavy(texts)
    assert ("en", "the") in heavy[1] and ("en", "the end") in heavy[2]
    stripes = texts.coalesce(1).mapInArrow(phrases._stripes(1, heavy[1]), phrases.STRIPE_SCHEMA)
    merged = stripes.sortWithinPartitions("lang", "prefix", "part").mapInArrow(phrases._merged(1, 2, heavy[1]), phrases.MERGED_SCHEMA).collect()
    pairs = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            pairs.update((lang or "und", f"{a} {b}") for a, b in zip(words, words[1:], strict=False))
    assert {(r["lang"], r["phrase"]): r["f"] for r in merged if r["kind"] == "phrase"} == {k: c for k, c in pairs.items() if c >= 2}
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute(rows)


def test_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_019, 3_000_000_037, 3_000_000_077)], "a long, l1 long, r1 long").select(phrases._cut_score(1)).first()[0]
    assert row == 1000000 * 3_000_000_019**2 // (3_000_000_037 * 3_000_000_077)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0

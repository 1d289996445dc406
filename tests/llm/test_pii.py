import hashlib
import random
import re

import pytest

from docsheaf.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checked(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if checked(k, m.group())]


def with_check_digit(rng, n=16):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(head + d for d in "0123456789" if pii.luhn(head + d))


def test_base_agrees_with_the_patterns():
    rng = random.Random(9)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "23", "456", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "%", "é", "\n", "4539578763621486", "1.2.3.4", "x@y.com"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + "-" * 300_000, "1 " * 100_000, "a@" * 100_000):
        pii.labelled(text)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    rows, hidden = [], []
    for k in range(n):
        words = [f"word{rng.randint(0, 999)}" for _ in range(20)]
        card, other, phone, ip = with_check_digit(rng), with_check_digit(rng), f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", f"10.{rng.randint(0, 255)}.3.4"
        if k % 3 == 0:
            words.insert(5, f"call {card}")
            words.insert(9, f"{phone}")
            words.insert(14, f"user{k}@mail.example.com")
        if k % 10 == 1:
            words.insert(7, f"{card} {other}")
            hidden += [(k, "card", card), (k, "card", other)]
        if k % 10 == 2:
            words.insert(7, f"{phone} {ip}")
            hidden.append((k, "phone", phone))
        if k % 10 == 3:
            words.insert(7, "release 1234567890123456")
        rows.append((k, " ".join(words)))
    return rows, hidden


def test_model_finds_what_the_patterns_miss(spark):
    rows, hidden = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = pii.fit(docs)
    found = {r["doc_id"]: r["spans"] for r in pii.detect(docs, model).collect()}
    texts = dict(rows)
    added = {(d, s["kind"], texts[d][s["start"] : s["end"]]) for d, spans in found.items() for s in spans if not s["base"]}
    missed = [h for h in hidden if h not in added]
    assert len(missed) <= 0.1 * len(hidden)
    assert not [a for a in added if a[2] == "1234567890123456"]
    assert len(added) <= len(hidden) * 1.2
    assert model.reliability["card"]["shape"]["yes"][0] > model.reliability["card"]["shape"]["no"][0]
    for d, spans in found.items():
        assert [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]] == plain(texts[d])


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_stage_and_edges(spark, sf_dir):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "mail a.b@c.de and 1.2.3.4.", "en", "s", 26), (3, "mail a.b@c.de and 1.2.3.4.", "en", "s", 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pii.stage(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = sorted((r["doc_id"], r["text"] or "", r["n_chars"]) for r in out.collect())
    clean = "mail <EMAIL> and <IP>."
    assert got == [(1, "", 0), (2, "", 0), (3, clean, len(clean)), (3, clean, len(clean))]
    assert pii.fit(docs.limit(0)).probability == {}
    assert pii.detect(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


@pytest.mark.parametrize("counts", [{"card:+++++": 3}, {"card:+0000": 5, "ip:-----": 5}])
def test_em_on_few_patterns(counts):
    assert all(0 <= p <= 1 for p in pii.expectation_maximisation(counts).probability.values())


def test_patterns_that_the_fit_has_not_seen_are_scored_by_the_weights(spark, sf_dir):
    model = pii.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    fitted = dict(model.probability)
    model.probability.clear()
    assert {p: model.accepts(p) for p in fitted} == {p: v >= pii.ACCEPT for p, v in fitted.items()}

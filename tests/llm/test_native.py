import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docsheaf.llm import chat, exact, quality, sharding, urls

WORD = re.compile("[^\x20\x09-\x0d]+")


def measured(text):
    """The measures in plain Python."""
    text = text or ""
    words = WORD.findall(text)
    spans = collections.defaultdict(list)
    for i in range(len(words) - 7):
        spans[tuple(words[i : i + 8])].append(i)
    repeated = {j for at in spans.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(repeated))


ODD = [None, "", " \n\t", "word", "a b c d e f g h a b c d e f g h", "x " * 400, "🙂 é\x0bü\n\n# $\n# $\n# $\n# $", " ", "l1\nl1\nl1 \nl2", "a\u2028b\x85c"]


def test_measures_against_plain_python(spark, sf_dir):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["a", "b", "#", "c\n", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows = [(k, t, "clash", 5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __words string, n_lines int")
    found = quality.measure(docs).collect()
    assert {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) for r in found} == {k: measured(t) for k, t, _, _ in rows}
    assert all((r["__words"], r["_n_lines"]) == ("clash", 5) for r in found)


def test_quality_stage_leaves_columns_alone(spark):
    rows = [(1, " ".join(f"w{j}" for j in range(45)), "mine", 7, None, "x"), (2, "few", "mine", 7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, fail_bits int, kept boolean, _kept string")
    out = quality.stage(spark, docs, "")
    assert out.schema == docs.schema and [tuple(r) for r in out.collect()] == rows[:1]


def test_policies_and_ablation(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    led = quality.ledger(docs).select("doc_id", "fail_bits")
    bits = [r["fail_bits"] for r in led.collect()]
    mask = quality.POLICIES[quality.CURRENT]
    assert quality.kept_rows(led).count() == sum(not b & mask for b in bits)
    for r in quality.ablation(led).collect():
        bit = 1 << r["bit"]
        assert r["failed"] == sum(bool(b & bit) for b in bits)
        assert r["rejects_alone"] == sum(bool(b & bit) and not b & mask & ~bit for b in bits)
    assert quality.kept_rows(led, "base").count() >= quality.kept_rows(led).count()
    assert quality.ledger(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection(n):
    out = sharding.permute(np.arange(n), n, seed=5)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 100 or (out[1:] - out[:-1] == 1).mean() < 0.05
    assert np.array_equal(out, sharding.permute(np.arange(n), n, seed=5))


def test_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.query(spark, sf_dir).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(text)
    slots = collections.defaultdict(list)
    for r in rows:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_place(number, n, seed):
    """The permutation in plain Python integers."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [(seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % 2**64 for i in range(sharding.ROUNDS)]
    while True:
        left, right = number >> half, number & (1 << half) - 1
        for key in keys:
            x = (right + key) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            left, right = right, left ^ (x ^ x >> 31) & (1 << half) - 1
        number = left << half | right
        if number < n:
            return number


def test_shards_against_plain_feistel(spark, sf_dir):
    rows = sorted(sharding.query(spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    for number, r in enumerate(rows):
        place = plain_place(number, len(rows), sharding.SEED)
        assert (r["shard"], r["slot"]) == (place % 16, place // 16)


def test_shards_with_nulls_ties_and_nothing(spark):
    rows = [(None, 1, 0)] * 3 + [(5, 1, 0)] * 4 + [(5, 9, 0)]
    df = spark.createDataFrame(rows, "doc_id long, size long, shard int").drop("shard").repartition(3)
    out = sharding.shard(df, ["doc_id", "size"], shards=3)
    got = collections.Counter(r["shard"] for r in out.collect())
    assert sorted(got.values()) == [2, 3, 3]
    assert sharding.shard(df.limit(0), ["doc_id", "size"]).count() == 0


def test_digests(spark):
    rows = [(1, "a\tb\x0b", "x"), (1, "a\tb\x0b", "x"), (2, "ab", "y"), (None, "ab", "z"), (3, None, ""), (4, " \r\f", ""), (5, "A b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = exact.deduplicate(docs).collect()
    by = {(r["doc_id"], bytes(r["digest"])): r for r in got}
    ab, empty = (hashlib.sha256(x).digest() for x in (b"ab", b""))
    assert len(got) == len(rows)
    assert by[1, ab]["kept"] and by[1, ab]["group_size"] == 4 and not by[2, ab]["kept"] and not by[None, ab]["kept"]
    assert by[4, empty]["keep_id"] == 4 and by[3, empty]["keep_id"] == 4
    assert exact.deduplicate(docs.limit(0)).count() == 0


def prefixes(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        text = text or ""
        convs[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest(), text))
    seqs = {c: tuple((r, t) for _, _, r, _, t in sorted(v)) for c, v in convs.items()}
    proper = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    best = {}
    for c in sorted(seqs, key=lambda c: (c is None, c or 0)):
        best.setdefault(seqs[c], c)
    return {c: s for s, c in best.items() if s not in proper}


def test_chat_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    rng = random.Random(8)
    rows = []
    base = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", None, ""])) for _ in range(12)]
    for conv in range(40):
        turns = base[: rng.randint(1, 12)] if conv % 3 else [(rng.choice("ab"), rng.choice("xy")) for _ in range(rng.randint(1, 5))]
        rows += [(conv, k * 2, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(100, None, "a", "x"), (101, 4, "u", "same"), (101, 4, "u", "same")]
    for k in range(20):  # a snapshot, and the longer one, in which a turn number stands twice
        rows += [(200 + k, 1, "user", f"q{k}"), (200 + k, 1, "assistant", f"tie{k}"), (300 + k, 1, "assistant", f"tie{k}"), (300 + k, 1, "user", f"q{k}"), (300 + k, 2, "user", "more")]
    rows += [(None, k, "u", f"no id {k}") for k in range(7)] + [(400, k, "u", f"no id {k}") for k in range(3)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, length int")
    parts = chat.collapse(df).collect()
    expected = prefixes(rows)
    assert {r["conv_id"]: r["n_turns"] for r in parts} == {c: len(s) for c, s in expected.items()}
    assert not {200 + k for k in range(20)} & set(expected) and 400 not in expected and None in expected
    text = collections.defaultdict(str)
    for r in sorted(parts, key=lambda r: r["part"]):
        assert r["rendered"].count(chat.TURN_END) <= 3
        text[r["conv_id"]] += r["rendered"]
    assert text == {c: "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in s) for c, s in expected.items()}
    assert chat.collapse(df.limit(0)).count() == 0


def judge(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = cut.group(1).translate({c: c + 32 for c in range(65, 91)}), cut.group(2)
    fits = []
    for action, rule in urls.RULES:
        domain, tail = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, action))
    return host, path, max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/1", "http://www.example.com/EN/", "http://x.net/es/", "http://x.net/en/", "http://notexample.com/en/", "http://example.com", "http://com/", "a://b://c.com/en", "http://bad.org/1", "http://good.org/1", "http://é.com/", "http://b.net/fr/\nx"]


def test_urls_against_plain_python(spark):
    link = '<a href="http://{}/1">x</a>'
    html = {13: link.format("x.net"), 14: link.format("good.org"), 4: link.format("Good.org"), 7: link.format("x.net") * 3}
    rows = [(k, u, html.get(k), "clash") for k, u in enumerate(URLS)] + [(99, "http://x.net/es/", None, "clash")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").drop("host")
    got = urls.filter_urls(pages, siblings=False).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] == 99:
            assert r["verdict"] == "block"
            continue
        host, path, (rule, action) = judge(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if action:
            assert r["verdict"] == action
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert verdict[13] == "block" and verdict[14] == "allow" and verdict[0] == verdict[2] == "allow" and verdict[8] == "block"
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_pagerank_against_plain_python(spark):
    rng = random.Random(6)
    edges = collections.Counter((rng.randint(0, 8), rng.randint(0, 8)) for _ in range(40))
    seeds = {0: 2.0, 3: 1.0}
    out = collections.Counter()
    for (a, _), w in edges.items():
        out[a] += w
    start = {k: v / 3 for k, v in seeds.items()}
    score = dict(start)
    for _ in range(urls.ITERATIONS):
        new = collections.defaultdict(float, {k: v * (1 - urls.DAMPING) for k, v in start.items()})
        for (a, b), w in edges.items():
            new[b] += urls.DAMPING * score.get(a, 0) * w / out[a]
        score = dict(new)
    df = spark.createDataFrame([(str(a), str(b), float(w)) for (a, b), w in edges.items()], "src string, dst string, weight double")
    got = {int(r["host"]): r["score"] for r in urls.propagate(df, spark.createDataFrame([(str(k), v) for k, v in seeds.items()], "host string, weight double")).collect()}
    assert {k: v for k, v in got.items() if v > 1e-12} == pytest.approx({k: v for k, v in score.items() if v > 1e-12})


def test_urls_reach_the_end_of_long_chains(spark):
    """What leads to blocked hosts is blocked at any distance; scores are those of the linear system, solved outright."""
    n = 15
    link = '<a href="http://{}/1">x</a>'
    pages = [(k, f"http://h{k}.org/1", link.format(f"h{k + 1}.org" if k + 1 < n else "x.net")) for k in range(n)]
    pages += [(100, "http://x.net/es/", link.format("x.net")), (101, "http://y.com/", link.format("c0.org")), (102, "http://c0.org/", link.format("c1.org")), (103, "http://c1.org/", link.format("c2.org")), (104, "http://c2.org/", link.format("c0.org") + link.format("x.net"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["host"]: r for r in urls.filter_urls(df, siblings=False).collect()}
    assert [got[f"h{k}.org"]["verdict"] for k in range(n)] == ["block"] * n
    forward = {host: re.findall(r"//([^/]+)/", html) for _, url, html in pages for host in [url.split("/")[2]]}
    links = {(a, b) for a, bs in forward.items() for b in bs if a != b}
    names = sorted({x for e in links for x in e})
    for column, seed, edges in (("trust", "y.com", links), ("distrust", "x.net", {(b, a) for a, b in links})):
        m = np.zeros((len(names), len(names)))
        for a, b in edges:
            m[names.index(b), names.index(a)] = 1 / sum(a == c for c, _ in edges)
        scores = np.linalg.solve(np.eye(len(names)) - urls.DAMPING * m, (1 - urls.DAMPING) * np.array([x == seed for x in names]))
        for name, score in zip(names, scores, strict=True):
            assert (got[name][column] or 0.0) == pytest.approx(score, rel=1e-6, abs=1e-15)

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docsheaf.llm import exact, ngram, pii, quality
from tests.llm.test_ngram import brute


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    led = {r["doc_id"]: r["kept"] for r in quality.apply_policy(quality.ledger(docs)).collect()}
    rows = [r for r in rows if led[r[0]]]
    best = {}
    for doc, text in rows:
        key = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        best[key] = max(best.get(key, (-1, 0)), (len(text), -doc))
    kept = {-d for _, d in best.values()}
    rows = [r for r in rows if r[0] in kept]
    near = {d for d, _, c in brute(rows) if d == c}
    rows = [r for r in rows if r[0] in near]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {d: len(library.encode(pii.redacted(t, model), add_special_tokens=False).ids) + 1 for d, t in rows}
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == expected[r["doc_id"]]
    assert got == expected


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema == docs.schema


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 3000, "en", "s", 15000)]
    rows += [(k, f"alpha{k} " + " ".join(f"w{j * k}" for j in range(40)), "en", "s", 1) for k in range(3, 9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
        assert stage(spark, docs, sf_dir).count() > 0, name
    assert {r["doc_id"] for r in quality.stage(spark, docs, sf_dir).collect()} == set(range(3, 9))
    assert exact.stage(spark, docs, sf_dir).count() == 8


def test_exact_index_persists(spark, tmp_path):
    index = exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=2)
    first = spark.createDataFrame([(1, "a b"), (2, "ab  "), (3, None), (4, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact.deduplicate(first, index).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True), 4: (4, True)}
    again = exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=2)
    more = spark.createDataFrame([(5, "abxxx"), (6, "A b"), (7, "a\tb"), (8, "\n")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact.deduplicate(more, again).collect()}
    assert got == {5: (5, True), 6: (6, True), 7: (2, False), 8: (3, False)}
    assert index.read().count() == 5
    assert np.array_equal(sorted(r["keep_id"] for r in again.read().collect()), [2, 3, 4, 5, 6])


def test_stages_keep_rows_with_null_and_repeated_ids(spark):
    def words(seed):
        return " ".join(f"w{seed}x{j}" for j in range(40))

    exact_rows = [(None, words(1)), (None, words(2)), (None, words(2)), (7, words(3)), (7, words(4)), (8, words(4) + " "), (9, words(5)), (None, words(5)), (None, None), (None, " ")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in exact_rows], "doc_id long, text string, k1 string")
    got = sorted(((r["doc_id"], r["text"]) for r in exact.stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, words(1)), (None, words(2)), (7, words(3)), (8, words(4) + " "), (9, words(5)), (None, " ")], key=str)
    near_rows = [(None, words(1)), (None, words(2)), (None, words(2) + " end"), (7, words(3)), (7, words(4)), (8, words(4) + " end"), (6, words(3) + " end"), (None, words(3) + " more"), (5, words(6)), (5, words(6)), (None, None), (None, None), (4, ""), (4, " ")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in near_rows], "doc_id long, text string, blank string")
    got = [(r["doc_id"], r["text"]) for r in ngram.stage(spark, docs, "").collect()]
    second = [g for g in got if g[0] is None and (g[1] or "").startswith("w2x")]
    assert len(second) == 1
    rest = sorted((g for g in got if g not in second), key=str)
    assert rest == sorted([(None, words(1)), (7, words(4)), (6, words(3) + " end"), (5, words(6)), (None, None), (None, None), (4, ""), (4, " ")], key=str)

"""Operations of a training-data pipeline.  Nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries():
    """Name -> query (spark, sf_dir) -> DataFrame."""
    from docsheaf.llm import bpe, chat, exact, minhash, ngram, packing, phrases, pii, quality, repeats, sharding, tokenfile, urls

    return {
        "op1_cost_packing": packing.query,
        "op2_recursive_bpe": bpe.query,
        "op3_feistel_shards": sharding.query,
        "op4_weak_pii": pii.query,
        "op5_chat_collapse": chat.query,
        "op6_url_trust": urls.query,
        "op7_trie_join": ngram.query,
        "op8_exact_dedup": exact.query,
        "op9_rans_files": tokenfile.query,
        "op10_quality_ledger": quality.query,
        "op11_stripe_phrases": phrases.query,
        "op12_suffix_runs": repeats.query,
        "op13_oph_stars": minhash.query,
    }


def oracle_sql():
    """Name -> DuckDB SQL, where SQL can say it."""
    from docsheaf.llm import chat, exact, phrases, quality

    return {"op5_chat_collapse": chat.SQL, "op8_exact_dedup": exact.SQL, "op10_quality_ledger": quality.SQL, "op11_stripe_phrases": phrases.SQL}

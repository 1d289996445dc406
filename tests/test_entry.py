import duckdb
import pytest

import __spark_entry__ as entry
from docsheaf.plans import checks, reviews, texts

SMALL = "doc_category_distribution longest_name_match redact_text list_item_records report_list_page version_append_guards rule_tree_counts condition_tree_eval verdict_consensus rule_pack task_feasibility spec_facts login_lockout display_intervals budget_packing".split()
SMALL += [*texts.QUERIES, *reviews.QUERIES, *checks.QUERIES]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    sql = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(repr([plain(v) for v in r]) for r in con.sql(f"SELECT {', '.join(columns)} FROM sql").fetchall())
    assert ours == theirs

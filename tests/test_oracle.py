"""Every registered query against its DuckDB statement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from oracle_check import rows_of
from scholia.plans.views import BASE

QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for table in BASE:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    assert got, "every query has rows on the smallest tables"
    if name in ORACLE:
        cur = con.execute(ORACLE[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["query_id", "rank", "score", "text", "chunk_id", "expanded", "display_score"]


def test_no_product_of_two_tables(spark, data):
    """Nested loops appear only against one-row statistics, products never."""
    one_row = {"corpus_stats", "idf"}
    for name in ("bm25_scores", "owning_components", "scope_match", "autolink_components", "route_score", "keyword_fallback",
                 "decision_violations", "affected_files", "autolink_titles", "autolink_tags"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in plan
        if name not in one_row and name not in ("bm25_scores", "scope_match"):
            assert "Join Cross" not in plan, name


def test_native_operators_stay_in_the_jvm(spark, data):
    for name in ("term_freq", "atomic_chunks", "contradiction_guard", "imports", "manifest_deps", "line_rules", "affected_files",
                 "usage_summary", "html_clean", "content_type"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInPandas" not in plan, name

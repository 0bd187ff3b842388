import duckdb
import pytest

import compare
from assayer.plans import all_queries

SAMPLE = (
    "table_stats_catalog", "column_profile", "scrub_documents", "keyword_category", "fast_report_customer", "remediation", "text_scores", "iqr_outliers_lineitem",
    "cdf_distances_quantity", "change_point", "catalog_upsert", "access_decision", "retention_sweep_limited", "export_sections", "review_stats", "user_plan_updates", "audit_mask",
)


@pytest.fixture(scope="module")
def engine(data):
    con = duckdb.connect()
    for table in compare.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, data, engine, name):
    query = all_queries()[name]
    df = query.build(spark, data)
    result = engine.execute(query.sql)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert compare.rows_of(df.columns, [tuple(r) for r in df.collect()]) == compare.rows_of(names, result.fetchall())


def test_entry_has_a_row(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Registered queries against their check SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

# The next larger data: some rules of the fixtures first show beyond the 50 pages of the smallest.
SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# One of each family; the whole list runs in the acceptance check.
NAMES = ["site_rollup", "link_kinds", "page_audit", "crawler_access", "hreflang_checks", "hreflang_report", "tracker_status", "tracker_evidence",
         "update_status", "duplicate_titles", "microdata_objects", "people_also_ask", "robots_large_files", "descendant_selectors", "named_references", "passage_copies",
         "cache_stream", "container_templates", "stamped_core_versions", "custom_technologies"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    assert sorted(df.columns) == sorted(cols)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=key)
    have = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key)
    assert have == want


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

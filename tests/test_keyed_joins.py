"""Queries that join or filter on keys made by ``urls.normalized``: plans stay small, rows are those of the SQL."""

from collections import Counter
from datetime import datetime

import duckdb
import pytest

import __spark_entry__
from linkloom.functions import urls
from linkloom.plans.report_queries import HOT

DAY = datetime(2024, 1, 1, 10, 30)
KEY = HOT.lower()
# fmt: off
TABLES = {
    "links": ("job_id string, source_id string, link_idx int, site string, source_kind string, source_url string, source_title string, canonical_key string", [
        ("j1", "p1", 0, "/sites/tool-crib", "page", "/sites/tool-crib/SitePages/A.aspx", "B title", KEY), ("j1", "p1", 0, "/sites/tool-crib", "page", "/sites/tool-crib/SitePages/A.aspx", "B title", KEY),
        ("j1", "p1", 1, "/sites/tool-crib", "page", "/sites/tool-crib/SitePages/A.aspx", "A title", "intranet.example" + KEY), ("j1", "d1", 0, "/sites/Hidden", "document", "/sites/Hidden/Docs/d.docx", None, KEY),
        ("j?", "p2", 0, None, "page", "https://intranet.example/p", None, "/teams/x/docs/ü.pdf"), ("j1", "p3", 0, "/sites/tool-crib", "page", "/q", "", "elsewhere.example/a"),
        ("j1", "p4", 0, "/sites/tool-crib", "page", "/sites/tool-crib/SitePages/A.aspx", "A title", "/sites/tool-crib/siteassets/sitepages/home/used.png"), ("j1", "p5", 0, "/sites/tool-crib", "page", "/q", "t", ""), ("j1", "p6", 0, "/", "page", "/q", "t", None),
    ]),
    "jobs": ("job_id string, started_at timestamp_ntz", [("j1", DAY)]),
    "files": ("file_ref string, library string", [(HOT, "Policies"), (HOT, "Policies"), ("/teams/x/Docs/%C3%BC.pdf", "Docs"), ("/sites/a/Docs/Forms/AllItems.aspx?id=/teams/x/docs/%25C3%25BC.pdf", "Policies"), ("/sites/a/Docs/no one.pdf", "Policies"), ("", "Policies"), (None, None)]),
    "assets": ("site_path string, url string, name string, size bigint, modified timestamp_ntz", [
        ("/sites/tool-crib", "/sites/tool-crib/SiteAssets/SitePages/Home/Used.png", "Used.png", 1, DAY), ("/sites/tool-crib", "/sites/Tool-Crib/SiteAssets/SitePages/Home/free%20one.png", "free one.png", 2, None),
        ("/sites/tool-crib", "/sites/Tool-Crib/SiteAssets/SitePages/Home/free%20one.png", "free one.png", 2, None), ("/sites/hidden", "/sites/Hidden/SiteAssets/a,b.png", None, None, DAY), (None, None, "x", 1, DAY), ("/sites/x", "", "x", 1, DAY),
    ]),
    "visible_sites": ("site_path string", [("/Sites/Tool-Crib",), ("",), (None,)]),
}
# fmt: on


def test_condition_on_a_key_is_not_written_out(spark):
    """One list form deep, as the whole was more than the planner ends with."""
    keyed = urls.normalized(spark.createDataFrame([("https://intranet.example/A%20b/",), ("",)], "u string"), "u", "k", 0)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    wanted = keyed.filter("k != ''")
    assert size(wanted) < 1.5 * size(keyed)
    assert [r["k"] for r in wanted.collect()] == ["intranet.example/a b"]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("keyed")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("query", ["acl2_backlink_gate", "jn1_lookup", "jn3_orphans", "snk5_library_csv", "agg10_orphan_totals", "jn2_lookup_batch", "jn3_orphans_of_scanned_sites"])
def test_rows_are_those_of_the_sql(spark, root, query):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM '{root}/{name}.parquet/*.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[query])
    names = [c[0] for c in found.description]
    want = found.fetchall()
    got = __spark_entry__.queries()[query](spark, root).select(*names).collect()
    assert want and Counter(map(tuple, got)) == Counter(want)

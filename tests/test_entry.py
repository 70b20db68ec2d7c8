"""The driver's contract: every query runs; those with SQL equal it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(map(repr, (tuple(plain(r[c]) for c in cols) for r in got.collect())))
    if name in entry.oracle_sql():
        rel = con.sql(entry.oracle_sql()[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert rows == sorted(map(repr, (tuple(plain(r[k]) for k in at) for r in rel.fetchall())))


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_on_native_paths(spark):
    for name in ("url_page_key", "text_cos", "top_n_per_category", "token_counts"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["extract_nav_links", "extract_blocks", "planted_fields", "meta_diff_title"])
def test_pages_are_parsed_once(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("raw(html") == (2 if name == "meta_diff_title" else 1)  # that one joins both sites' pages

"""Queries against their SQL on small tables with values that the driver's smallest tables lack."""

import duckdb

import __spark_entry__ as entry


def same(spark, tmp_path, name, table, rows, ddl):
    """The query's rows, which equal its SQL's."""
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.sql(entry.oracle_sql()[name]).fetchall()))
    return got


def test_image_keys_of_large_numbers(spark, tmp_path):
    rows = [(k, size) for k in (7, 99_999, 100_000, 1_234_567) for size in range(1, 9)]
    assert len(same(spark, tmp_path, "image_keys", "part", rows, "p_partkey long, p_size int")) == 32


def test_titles_with_other_references(spark, tmp_path):
    titles = ["a &quot;b&quot;", "x &amp;&amp", "&amp;quot; &copy; y &middot; z", "&lt;b&gt; &#39;c", "plain & simple"]
    page = '<!doctype html><html lang="en"><head><title>{0}</title></head><body><h1>{0}</h1></body></html>'
    rows = [(k, f"https://x.example/{k}", page.format(t)) for k, t in enumerate(titles)]
    got = same(spark, tmp_path, "extract_title_h1_lang", "pages", rows, "page_id long, url string, html string")
    assert {r[0]: r[1] for r in got}[0] == "a &quot;b&quot;"

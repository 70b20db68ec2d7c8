"""The pipeline's stages on small tables, each against brute force, and the queries with SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = entry.queries()[name](spark, DATA)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in rel.fetchall())


def test_one_query_for_each_operator():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_stages(spark, docs, prose, tmp_path):
    sf = str(tmp_path)
    good = [prose(k, 30, lines=3) for k in range(40)]
    junk = ["!!! ### $$$ *** " * 40 + str(k) for k in range(40)]
    passage = prose(1234, 80)
    texts = [*good, *junk]
    texts[3] += "\n" + passage
    texts[7] += "\n" + passage
    texts += [good[5], good[6].replace(good[6].split(" ")[50], "edited"), None, ""]
    spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    rows = docs(texts)
    rows.write.parquet(f"{sf}/documents.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        if k < 4:
            assert now.columns == rows.columns
        ids[name] = sorted(r["doc_id"] for r in now.select("doc_id").distinct().collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    assert ids["quality"] == [*range(40), 80, 81]
    assert ids["exact_dedup"] == [k for k in [*range(40), 80, 81] if k != 5]  # of equal texts the largest id stays
    assert ids["near_dedup"] == [k for k in ids["exact_dedup"] if k != 81]
    cut = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/substring_dedup").collect()}
    assert passage in cut[3] and passage not in cut[7] and cut[0] == good[0] and ids["packing"] == ids["near_dedup"]
    assert corpus_pipeline.run(spark, sf).count() == now.count()


def test_stages_of_an_empty_table(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs([]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0


def test_stages_take_odd_rows(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs([(1, "some plain words"), (1, "some plain words"), (None, "other words here"), (3, None), (4, ""), (5, "w " * 100_000)]).withColumn("rep", F.lit("x")).withColumn("recipe", F.lit(None).cast("string"))
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        assert k == 4 or now.columns == columns
    assert now.count() > 0

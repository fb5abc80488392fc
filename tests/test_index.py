"""The index and its statistics: invariances, the registered queries against DuckDB, and the streaming form."""

import os

import __spark_entry__
import duckdb
import pytest
from pyspark.sql import functions as F
from refweave import streaming
from refweave.operators import extract, index
from refweave.plans import queries
from refweave.sources import synthetic

DATA = "/root/testdata/sf0.001"


def rows(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows(found, columns) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_page_statistics_take_every_crawl_of_a_url(spark, tmp_path):
    link = '<a href="/{}">x</a>'
    crawls = [("http://a.com/", link.format("p")), ("http://a.com/", link.format("q")), ("http://a.com:80/", link.format("r")), ("http://b.com/", link.format("p"))]
    spark.createDataFrame([(i, *c) for i, c in enumerate(crawls)] + [(1, *crawls[1])], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["page_index_stats"])
    found = queries.QUERIES["page_index_stats"](spark, str(tmp_path)).first().asDict()
    assert found == dict(zip(want.columns, want.fetchall()[0], strict=True)) and found["links_emitted"] == 4


@pytest.mark.parametrize("name", ["page_edges_internal", "page_edges_external", "page_file_edges", "max_pages"])
def test_page_edges_come_once_from_several_forms_of_a_url(spark, tmp_path, name):
    link = '<a href="/p">x</a><a href="http://b.com/p">x</a>'
    forms = ["http://a.com/x", "http://a.com/x#top", "http://A.com:80/x", "http://a.com/y"]
    spark.createDataFrame([(i, u, link) for i, u in enumerate(forms)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL[name]).fetchall())
    found = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select("source", "target").collect())
    assert found == want and len(want) == (2 if name == "page_edges_external" else 4)


def test_decoding_and_escaping_meet_values_of_the_tables(spark):
    data = "/root/testdata/sf0.1"
    pages, docs = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("pages", "documents"))
    assert queries.QUERIES["entity_decode_pages"](spark, data).join(pages, "page_id").where("decoded <> html").count() > 100
    assert queries.QUERIES["text_escape_documents"](spark, data).join(docs, "doc_id").where("escaped <> text and back = text").count() > 9000


def test_index_does_not_depend_on_partitions_order_or_repeats(spark):
    edges = synthetic.generate(spark, 400, 5)
    want = rows(index.backlinks(edges))
    assert rows(index.backlinks(edges.orderBy(F.desc("target")).repartition(7))) == want
    assert rows(index.backlinks(edges.unionByName(edges))) == want
    halves = [edges.where(F.pmod(F.xxhash64("source"), F.lit(2)) == i) for i in (0, 1)]
    assert rows(index.merge_indexes(*(index.backlinks(h) for h in halves))) == want
    for n in ("1", "16"):
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert rows(index.backlinks(edges)) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)


def test_chunks_hold_every_source_once(spark):
    edges = synthetic.generate(spark, 400, 8)
    chunks = index.backlinks_in_chunks(edges, 5)
    whole = chunks.groupBy("target").agg(F.sort_array(F.flatten(F.collect_list("sources"))).alias("sources"))
    assert rows(whole) == rows(index.backlinks(edges))
    assert chunks.groupBy("target").count().agg(F.max("count")).first()[0] > 1


def test_empty_edges(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert index.stats(none).first().asDict() == {"links_emitted": 0, "backlink_keys": 0, "backlink_edges": 0, "max_fan_in": 0, "distinct_sources": 0}
    assert index.backlinks(none).count() == 0


def test_page_scan_reads_two_columns_and_filters_stay_above_the_normalizer(spark):
    plan = extract.pages_to_edges(spark.read.parquet(f"{DATA}/pages.parquet"), include_internal=True)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string,html:string>" in plan


def test_max_pages_keeps_the_first(spark):
    pages = spark.createDataFrame([(i, f"http://a{i}.com/", f'<a href="http://b.com/{i}">x</a>' if i != 1 else "") for i in range(4)], "page_id long, url string, html string")
    got = extract.pages_to_edges(pages, max_pages=2, order="page_id")
    assert sorted(r["source"] for r in got.collect()) == ["http://a0.com/", "http://a2.com/"]


@pytest.mark.parametrize("name", ["max_pages", "derived_edges_external", "backlinks_pages", "normalize_urls"])
def test_page_queries_run_no_python(spark, name):
    assert "EvalPython" not in queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_streamed_index_equals_batch_and_survives_reruns(spark, tmp_path):
    edges = synthetic.generate(spark, 100, 4)
    edges.repartition(3).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("checkpoint", "checkpoint", "lost"):
        stream = spark.readStream.schema("source string, target string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streaming.maintain_edges(stream, str(tmp_path / "table"), str(tmp_path / checkpoint), every=2).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "table").glob("*/*=*")) == ["batch=2", "upto=1"]
    assert rows(streaming.read_index(spark, str(tmp_path / "table"))) == rows(index.backlinks(edges))


def test_index_of_an_empty_stream_table(spark, tmp_path):
    assert streaming.read_index(spark, str(tmp_path / "none")).count() == 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""The registered queries of the link-graph engine, and the same in DuckDB's SQL.

Indexes come out with their sources as one text, parted by blanks. Edge lists are taken from lineitem (supplier to part), pages
from pages; literal tables stand in where no table has such values, or add rarer ones to what a table has. Pages link within their sites only, so internal links count;
the derived_ queries put links of all other kinds into pages of their own, made of page_id. Archives, dumps and page files are made of pages and read back.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import hashing, html, jsonpath, text, urls, wiki
from ..operators import extract, index
from ..sources import edgelist, pagefile, sinks, synthetic, warc, wikidump

K = 20


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def _page_edges(spark: SparkSession, d: str, **how) -> DataFrame:
    return extract.pages_to_edges(_pages(spark, d), **({"include_internal": True, "once": True} | how))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select(F.col("l_suppkey").cast("string").alias("source"), F.col("l_partkey").cast("string").alias("target"))


def _flat(found: DataFrame) -> DataFrame:
    return found.select("target", F.array_join("sources", " ").alias("sources"))


def _values(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "v string")


def _sql_values(values: list[str]) -> str:
    return "(VALUES " + ", ".join("('" + v.replace("'", "''") + "')" for v in values) + ") t(v)"


WIKI = ["https://x.org/wiki/Cat", "https://x.org/wiki/File:X.png", "https://x.org/wiki/User_talk:Bob", "https://x.org/wiki/A?action=edit", "https://x.org/wiki/", "https://x.org/w/index.php", "https://x.org/wiki/2001:_A_Space_Odyssey", "https://x.org/wiki/:Odd", "https://x.org/wiki/Help_:Me", "https://x.org/wiki/New_York+City"]
ENTITIES = ["a&amp;b", "&amp;quot;x", "&#38;&#x26;", "it&#39;s", "&AMP;", "plain"]
ESCAPES = ["a\tb", "c\nd", "e\\f", "g\rh", "plain", ""]
NODES = ["Node 1.local", "a_b-c", "ÜBER", ""]
LINES = ["# note", "% note", "", "0\t11342", "0 11342", "0,11342", "0   7", "0 7 0.5", "5 5", " 1 2", "lonely", "3 ", "4 ,5"]

# SQL parts
_ANCHORS = r"""unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1))"""
_UNQUOTED = """CASE WHEN r[1] IN ('"', '''') THEN r[2:len(r) - 1] ELSE r END"""
_HREFS = f"SELECT page_id, url, {_UNQUOTED} AS href FROM (SELECT page_id, url, {_ANCHORS} AS r FROM pages)"
_LEGAL = r"[^A-Za-z0-9_\-!.~''()*:@&=+$,;/]"
# root-relative, protocol-relative and absolute links of legal ASCII, which is what the tables hold
_ORIGIN = r"regexp_extract(trim(u), '^([A-Za-z]+://[^/?#]+)', 1)"


def _canonical(whole: str) -> str:
    """SQL for the canonical form of an absolute URL."""
    parts = f"regexp_extract({whole}, '^([A-Za-z]+)://([^/?#]+)([^?#]*)(\\?[^#]*)?', ['s', 'h', 'p', 'q'])"
    encoded = lambda part: f"array_to_string([CASE WHEN regexp_matches(c, '[^\\x00-\\x7F]') THEN url_encode(c) ELSE c END FOR c IN string_split(nfc_normalize({part}), '')], '')"
    return f"""(SELECT lower(x.s) || '://' || regexp_replace(regexp_replace(lower(x.h), '^[^@]*@', ''), CASE WHEN lower(x.s) = 'http' THEN ':80$' ELSE ':443$' END, '')
      || CASE WHEN x.p = '' THEN '/' ELSE {encoded('x.p')} END || CASE WHEN x.q IN ('', '?') THEN '' ELSE {encoded('x.q')} END FROM (SELECT {parts} AS x))"""


_DECODED = "replace(replace(replace(replace(replace(href, '&amp;', '&'), '&#38;', '&'), '&#x26;', '&'), '&quot;', '\"'), '&#39;', '''')"
_PAGE_LINKS = f"""
links AS (
  SELECT page_id, {_canonical('trim(url)')} AS source,
    {_canonical("CASE WHEN d LIKE '/%' THEN regexp_extract(trim(url), '^([A-Za-z]+://[^/?#]+)', 1) || d ELSE d END")} AS target
  FROM (SELECT page_id, url, {_DECODED} AS d FROM ({_HREFS})) WHERE d LIKE '/%' OR d LIKE 'http%'
), page_edges AS (
  SELECT DISTINCT source, target FROM links WHERE source <> target
)"""
_EDGES = "edges AS (SELECT CAST(l_suppkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target FROM lineitem)"
_HOST = "lower(regexp_extract({}, '^[A-Za-z]+://([^/?#:]+)', 1))"
_INDEX = "SELECT target, array_to_string(list_sort(list(DISTINCT source)), ' ') AS sources FROM {} GROUP BY target"
_FAN_IN = "fan AS (SELECT target, CAST(count(DISTINCT source) AS BIGINT) AS fan_in FROM {} GROUP BY target)"
_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(('0x' || hex(encode(url))[2 * i - 1:2 * i]) AS BIGINT) FOR i IN range(1, strlen(url) + 1)]), lambda h, b: (h * 31 + b) & 4294967295)"
_SIGNED = f"CASE WHEN {_HASH} >= 2147483648 THEN {_HASH} - 4294967296 ELSE {_HASH} END"


def _index_stats(spark: SparkSession, d: str) -> DataFrame:
    counted = index.stats(_page_edges(spark, d))
    return counted.select("links_emitted", "backlink_keys", "backlink_edges", "max_fan_in", "distinct_sources")


def _resolved(spark: SparkSession, d: str, how: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    own = urls.with_resolved(_pages(spark, d).select("url"), "target", F.col("url")).select("target").where("target is not null").distinct()
    return how(_flat(index.backlinks(_page_edges(spark, d))), own)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    found = index.backlinks(_edges(spark, d))
    return _flat(index.merge_indexes(found, found))


def _derived(spark: SparkSession, d: str) -> DataFrame:
    """A page for each of pages, with relative, protocol-relative, absolute and unusable links, entities, a base, and a decomposed letter."""
    i, text = F.col("page_id"), lambda c: c.cast("string")
    base = F.when(i % 4 == 0, '<base href="https://b.example/q/">').otherwise("")
    links = [F.lit('<a href="n'), text(i + 1), F.lit(".html#x\">x</a><a class=x href='//t"), text(i % 5), F.lit(".example/x?q=1&amp;r="), text(i)]
    links += [F.lit("'>x</a><a href=HTTPS://S"), text((i + 1) % 11), F.lit(".EXAMPLE:443/d/p"), text(i + 1)]
    links += [F.lit('>x</a><a href="mailto:a@b.c">x</a><a href="#top">x</a><a href="../up/./x">x</a><a href="https://t0.example/cafe\u0301">x</a>')]
    return _pages(spark, d).select(F.concat(F.lit("https://s"), text(i % 11), F.lit(".example/d/p"), text(i)).alias("url"), F.concat(base, *links).alias("html"))


def _derived_external(spark: SparkSession, d: str, how: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    pages = _derived(spark, d)
    return _flat(how(index.backlinks(extract.pages_to_edges(pages)), pages.select(F.col("url").alias("target"))))


def _record(kind: str, url: Column, body: Column) -> Column:
    head = F.concat(F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _warc(spark: SparkSession, d: str) -> DataFrame:
    """An archive for each of pages: a request, and a response of some content type, whose charset may be none of text."""
    kinds = F.array(*(F.lit(x) for x in ("text/html; charset=utf-8", "image/png", "application/xhtml+xml; charset=hex", "Text/HTML")))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int")), F.lit("\r\n\r\n"), F.col("html"))
    content = F.concat(_record("request", F.col("url"), F.lit("GET / HTTP/1.1\r\n\r\n")), _record("response", F.col("url"), body))
    return warc.html_pages(warc.parse(_pages(spark, d).select(F.lit("a.warc").alias("path"), F.encode(content, "UTF-8").alias("content"))))


def _dump(spark: SparkSession, d: str) -> DataFrame:
    """A packed dump for each of pages, its line parted over two members, behind a bad line and an empty article."""

    @F.pandas_udf(BinaryType())
    def packed(url: pd.Series, html: pd.Series) -> pd.Series:
        def one(u: str, h: str) -> bytes:
            lines = b"no JSON\n" + json.dumps({"url": u}).encode() + b"\n" + json.dumps({"url": u, "article_body": {"html": h}}).encode()
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w") as tar:
                for i, part in enumerate((lines[: len(lines) // 2], lines[len(lines) // 2 :])):
                    info = tarfile.TarInfo(f"{i}.ndjson")
                    info.size = len(part)
                    tar.addfile(info, io.BytesIO(part))
            return gzip.compress(out.getvalue(), 1)

        return pd.Series([one(u, h) for u, h in zip(url, html, strict=True)])

    return wikidump.parse(_pages(spark, d).select(packed("url", "html").alias("content")))


def _page_file(spark: SparkSession, d: str) -> DataFrame:
    known = _page_edges(spark, d).groupBy("source").agg(F.collect_list(F.concat(F.lit("LINK "), "target")).alias("links"))
    return pagefile.edges(pagefile.parse(known.select(F.lit("a.page").alias("path"), F.concat(F.lit("LINK lost\nURL "), "source", F.lit("\nnoise\n"), F.array_join("links", "\n"), F.lit("\n")).alias("value"))))


def _edge_file(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    sign = F.element_at(F.array(F.lit("\t"), F.lit(" "), F.lit(","), F.lit("  ")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    good = F.concat(F.col("l_suppkey").cast("string"), sign, F.col("l_partkey").cast("string"), F.lit(" 0.5"))
    lines = rows.select(F.explode(F.array(F.lit("# note"), good, F.lit("lonely"))).alias("value"))
    return edgelist.parse(lines).where("not malformed").select("source", "target")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "extract_hrefs": lambda s, d: extract.hrefs(_pages(s, d), "page_id"),
    "entity_decode": lambda s, d: _values(s, ENTITIES).select("v", html.decode_entities(F.col("v")).alias("decoded")),
    "entity_decode_pages": lambda s, d: _pages(s, d).select("page_id", html.decode_entities(F.col("html")).alias("decoded")),
    "normalize_urls": lambda s, d: urls.with_resolved(_pages(s, d).select("page_id", "url"), "canonical", F.col("url")).select("page_id", "canonical"),
    "host_of": lambda s, d: _pages(s, d).select("page_id", urls.host_of(F.col("url")).alias("host")),
    "same_site": lambda s, d: _pages(s, d).select("page_id", urls.same_site(urls.host_of(F.col("url")), F.regexp_replace(urls.host_of(F.col("url")), "^(m|blog)", "www")).alias("same")),
    "page_edges_internal": lambda s, d: _page_edges(s, d),
    "page_edges_external": lambda s, d: _page_edges(s, d, include_internal=False),
    "backlinks_pages": lambda s, d: _flat(index.backlinks(_page_edges(s, d))),
    "page_index_stats": _index_stats,
    "max_pages": lambda s, d: _page_edges(s, d, max_pages=K, order="page_id"),
    "partition_bucket": lambda s, d: _pages(s, d).select("page_id", hashing.partition_hash(F.col("url")).alias("hash"), hashing.bucket(F.col("url"), 32).alias("bucket")),
    "partition_sizes": lambda s, d: _pages(s, d).groupBy(hashing.bucket(F.col("url"), 32).alias("bucket")).agg(F.count("*").alias("pages")),
    "sha256_pages": lambda s, d: _pages(s, d).select("page_id", hashing.sha256_hex(F.col("html")).alias("digest")),
    "tsv_lines": lambda s, d: index.tsv_lines(index.backlinks(_page_edges(s, d))),
    "resolved_targets": lambda s, d: _resolved(s, d, index.resolved_targets),
    "dangling_targets": lambda s, d: _resolved(s, d, index.dangling_targets),
    "top_targets_per_host": lambda s, d: index.top_targets_per_host(_page_edges(s, d), 3),
    "edge_list_scan": lambda s, d: _edges(s, d),
    "edge_list_lines": lambda s, d: edgelist.parse(_values(s, LINES).withColumnRenamed("v", "value")),
    "backlinks_edges": lambda s, d: _flat(index.backlinks(_edges(s, d))),
    "backlinks_in_chunks": lambda s, d: index.backlinks_in_chunks(_edges(s, d), 20).groupBy("target").agg(F.sum(F.size("sources")).cast("long").alias("n"), F.max(F.size("sources") > 0).alias("some")),
    "union_dedup": lambda s, d: _flat(index.backlinks(_edges(s, d).unionByName(_edges(s, d)))),
    "merge_indexes": _merged,
    "distinct_edges": lambda s, d: index.distinct_edges(_edges(s, d)),
    "fan_in": lambda s, d: index.fan_in(_edges(s, d)),
    "edge_count": lambda s, d: index.distinct_edges(_edges(s, d)).agg(F.count("*").alias("backlink_edges")),
    "key_count": lambda s, d: _edges(s, d).agg(F.countDistinct("target").alias("backlink_keys")),
    "max_fan_in": lambda s, d: index.fan_in(_edges(s, d)).agg(F.max("fan_in").alias("max_fan_in")),
    "distinct_sources": lambda s, d: _edges(s, d).agg(F.countDistinct("source").alias("distinct_sources")),
    "index_stats": lambda s, d: index.stats(_edges(s, d)),
    "metric_lines": lambda s, d: sinks.metric_lines(index.stats(_edges(s, d)).select("backlink_keys", "backlink_edges")),
    "skew_profile": lambda s, d: index.skew_profile(_edges(s, d)),
    "top_targets": lambda s, d: index.top_targets(_edges(s, d), K),
    "self_links_kept": lambda s, d: _edges(s, d).where("source = target"),
    "adjacency": lambda s, d: edgelist.adjacency(_edges(s, d)).select("source", F.array_join("targets", " ").alias("targets")),
    "is_article": lambda s, d: _values(s, WIKI).select("v", wiki.is_article(F.col("v")).alias("article")),
    "title_of": lambda s, d: _values(s, WIKI).select("v", wiki.title_of(F.col("v")).alias("title")),
    "text_escape": lambda s, d: _values(s, ESCAPES).select("v", text.escape(F.col("v")).alias("escaped"), text.unescape(text.escape(F.col("v"))).alias("back")),
    "text_escape_documents": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", text.escape(F.col("text")).alias("escaped"), text.unescape(text.escape(F.col("text"))).alias("back")),
    "sanitize": lambda s, d: _values(s, NODES).select("v", text.sanitize(F.col("v")).alias("clean"), text.is_partition_id(F.col("v")).alias("valid")),
    "human_units": lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.human_bytes(F.col("o_orderkey") * 1024).alias("size"), text.human_millis(F.col("o_orderkey") * 10).alias("time")),
    "locality_rate": lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", text.locality_rate(F.col("n_nationkey"), F.col("n_regionkey")).alias("rate")),
    "json_path": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"), jsonpath.json_string(F.col("props"), "k").alias("k_string")),
    "median_duration": lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(index.integer_median(F.floor("value")).alias("median")),
    "synthetic": lambda s, d: synthetic.generate(s, 2000, 8),
    "text_unescape": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", text.unescape(F.concat(F.lit("\\q\x00"), "text", F.lit("\\n\\\\n\\"))).alias("plain")),
    "json_first": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", jsonpath.json_string(F.concat(F.lit('{"a":[1,"}"],"k":"'), "event_type", F.lit('","k":"late", broken')), "k").alias("k")),
    "warc_pages": _warc,
    "dump_pages": _dump,
    "page_file_edges": _page_file,
    "edge_file": _edge_file,
    "derived_edges": lambda s, d: extract.pages_to_edges(_derived(s, d), include_internal=True),
    "derived_edges_external": lambda s, d: extract.pages_to_edges(_derived(s, d)),
    "derived_resolved": lambda s, d: _derived_external(s, d, index.resolved_targets),
    "derived_dangling": lambda s, d: _derived_external(s, d, index.dangling_targets),
}

_WITH_PAGES = f"WITH {_PAGE_LINKS} "
_OWN = f", own AS (SELECT DISTINCT {_canonical('trim(url)')} AS target FROM pages)"
_STATS = """CAST((SELECT count(*) FROM {0}) AS BIGINT) AS links_emitted, CAST((SELECT count(DISTINCT target) FROM {0}) AS BIGINT) AS backlink_keys,
  CAST((SELECT count(*) FROM (SELECT DISTINCT source, target FROM {0})) AS BIGINT) AS backlink_edges,
  (SELECT max(fan_in) FROM fan) AS max_fan_in, CAST((SELECT count(DISTINCT source) FROM {0}) AS BIGINT) AS distinct_sources"""
_FIX = "(SELECT DISTINCT source, target FROM page_edges) p"
_HOME = "CASE WHEN page_id % 4 = 0 THEN 'https://b.example/' ELSE 'https://s' || page_id % 11 || '.example/' END"
_DERIVED = f"""WITH derived AS (
  SELECT page_id, 'https://s' || page_id % 11 || '.example/d/p' || page_id AS source, unnest([
    {_HOME} || CASE WHEN page_id % 4 = 0 THEN 'q' ELSE 'd' END || '/n' || (page_id + 1) || '.html', 'https://t' || page_id % 5 || '.example/x?q=1&r=' || page_id,
    'https://s' || (page_id + 1) % 11 || '.example/d/p' || (page_id + 1), {_HOME} || 'up/x', 'https://t0.example/caf%C3%A9']) AS target FROM pages
), outward AS (
  SELECT DISTINCT source, target FROM derived WHERE {_HOST.format('source')} <> {_HOST.format('target')}
), own AS (
  SELECT DISTINCT source AS target FROM derived
) """

ORACLE_SQL = {
    "extract_hrefs": f"SELECT page_id, href FROM ({_HREFS})",
    "entity_decode": f"SELECT v, {_DECODED.replace('href', 'v')} AS decoded FROM {_sql_values(ENTITIES)}",
    "entity_decode_pages": f"SELECT page_id, {_DECODED.replace('href', 'html')} AS decoded FROM pages",
    "normalize_urls": f"SELECT page_id, {_canonical('trim(url)')} AS canonical FROM pages",
    "host_of": f"SELECT page_id, {_HOST.format('url')} AS host FROM pages",
    "same_site": f"""SELECT page_id, regexp_replace({_HOST.format('url')}, '^www\\.', '') = regexp_replace(regexp_replace({_HOST.format('url')}, '^(m|blog)', 'www'), '^www\\.', '') AS same FROM pages""",
    "page_edges_internal": _WITH_PAGES + "SELECT source, target FROM page_edges",
    "page_edges_external": _WITH_PAGES + f"SELECT source, target FROM page_edges WHERE regexp_replace({_HOST.format('source')}, '^www\\.', '') <> regexp_replace({_HOST.format('target')}, '^www\\.', '')",
    "backlinks_pages": _WITH_PAGES + _INDEX.format("page_edges"),
    "page_index_stats": _WITH_PAGES + ", " + _FAN_IN.format("page_edges") + " SELECT " + _STATS.format("page_edges"),
    "max_pages": _WITH_PAGES + f"SELECT DISTINCT source, target FROM links WHERE source <> target AND page_id IN (SELECT DISTINCT page_id FROM links WHERE source <> target ORDER BY page_id LIMIT {K})",
    "partition_bucket": f"SELECT page_id, CAST({_SIGNED} AS BIGINT) AS hash, CAST((({_SIGNED}) % 32 + 32) % 32 AS BIGINT) AS bucket FROM pages",
    "partition_sizes": f"SELECT CAST((({_SIGNED}) % 32 + 32) % 32 AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS pages FROM pages GROUP BY 1",
    "sha256_pages": "SELECT page_id, sha256(html) AS digest FROM pages",
    "tsv_lines": _WITH_PAGES + "SELECT target || chr(9) || array_to_string(list_sort(list(DISTINCT source)), ' ') AS value FROM page_edges GROUP BY target",
    "resolved_targets": _WITH_PAGES + _OWN + _INDEX.format("page_edges SEMI JOIN own USING (target)"),
    "dangling_targets": _WITH_PAGES + _OWN + _INDEX.format("page_edges ANTI JOIN own USING (target)"),
    "top_targets_per_host": _WITH_PAGES + ", " + _FAN_IN.format("page_edges") + f" SELECT {_HOST.format('target')} AS host, CAST(row_number() OVER (PARTITION BY {_HOST.format('target')} ORDER BY fan_in DESC, target) AS INTEGER) AS rank, target, fan_in FROM fan QUALIFY row_number() OVER (PARTITION BY {_HOST.format('target')} ORDER BY fan_in DESC, target) <= 3",
    "edge_list_scan": f"WITH {_EDGES} SELECT source, target FROM edges",
    "edge_list_lines": f"SELECT regexp_extract(v, '^([^\\t ,]+)[\\t ,]\\s*([^\\t ,]+)', 1) AS source, regexp_extract(v, '^([^\\t ,]+)[\\t ,]\\s*([^\\t ,]+)', 2) AS target, NOT regexp_matches(v, '^([^\\t ,]+)[\\t ,]\\s*([^\\t ,]+)') AS malformed FROM {_sql_values(LINES)} WHERE v <> '' AND v[1] NOT IN ('#', '%')",
    "backlinks_edges": f"WITH {_EDGES} " + _INDEX.format("edges"),
    "backlinks_in_chunks": f"WITH {_EDGES} SELECT target, CAST(count(DISTINCT source) AS BIGINT) AS n, true AS some FROM edges GROUP BY target",
    "union_dedup": f"WITH {_EDGES} " + _INDEX.format("(SELECT * FROM edges UNION ALL SELECT * FROM edges)"),
    "merge_indexes": f"WITH {_EDGES} " + _INDEX.format("edges"),
    "distinct_edges": f"WITH {_EDGES} SELECT DISTINCT target, source FROM edges",
    "fan_in": f"WITH {_EDGES}, " + _FAN_IN.format("edges") + " SELECT target, fan_in FROM fan",
    "edge_count": f"WITH {_EDGES} SELECT CAST(count(*) AS BIGINT) AS backlink_edges FROM (SELECT DISTINCT source, target FROM edges)",
    "key_count": f"WITH {_EDGES} SELECT CAST(count(DISTINCT target) AS BIGINT) AS backlink_keys FROM edges",
    "max_fan_in": f"WITH {_EDGES}, " + _FAN_IN.format("edges") + " SELECT max(fan_in) AS max_fan_in FROM fan",
    "distinct_sources": f"WITH {_EDGES} SELECT CAST(count(DISTINCT source) AS BIGINT) AS distinct_sources FROM edges",
    "index_stats": f"WITH {_EDGES}, " + _FAN_IN.format("edges") + " SELECT " + _STATS.format("edges"),
    "metric_lines": f"WITH {_EDGES} SELECT 'METRIC backlink_keys=' || count(DISTINCT target) AS value FROM edges UNION ALL SELECT 'METRIC backlink_edges=' || count(*) FROM (SELECT DISTINCT source, target FROM edges)",
    "skew_profile": f"WITH {_EDGES}, " + _FAN_IN.format("edges") + " SELECT fan_in, CAST(count(*) AS BIGINT) AS keys FROM fan GROUP BY fan_in",
    "top_targets": f"WITH {_EDGES}, " + _FAN_IN.format("edges") + f" SELECT target, fan_in FROM fan ORDER BY fan_in DESC, target LIMIT {K}",
    "self_links_kept": f"WITH {_EDGES} SELECT source, target FROM edges WHERE source = target",
    "adjacency": f"WITH {_EDGES} SELECT source, array_to_string(list_sort(list(target)), ' ') AS targets FROM edges GROUP BY source",
    "is_article": f"""SELECT v, v LIKE '%/wiki/_%' AND v NOT LIKE '%?%' AND NOT (position(':' IN regexp_extract(v, '/wiki/(.*)', 1)) > 1
      AND lower(trim(replace(split_part(regexp_extract(v, '/wiki/(.*)', 1), ':', 1), '_', ' '))) IN ({', '.join(repr(n) for n in wiki.NO_ARTICLES)})) AS article FROM {_sql_values(WIKI)}""",
    "title_of": f"SELECT v, CASE WHEN v LIKE '%/wiki/%' THEN replace(url_decode(replace(regexp_extract(v, '/wiki/(.*)', 1), '+', ' ')), '_', ' ') ELSE v END AS title FROM {_sql_values(WIKI)}",
    "text_escape": "SELECT v, replace(replace(replace(replace(v, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') AS escaped, v AS back FROM " + _sql_values(ESCAPES),
    "text_escape_documents": "SELECT doc_id, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') AS escaped, text AS back FROM documents",
    "sanitize": f"SELECT v, lower(regexp_replace(v, '[^A-Za-z0-9_-]', '-', 'g')) AS clean, regexp_full_match(v, '[A-Za-z0-9._-]{{1,128}}') AND v NOT IN ('.', '..') AS valid FROM {_sql_values(NODES)}",
    "human_units": """SELECT o_orderkey, CASE WHEN o_orderkey < 1 THEN o_orderkey * 1024 || ' B' WHEN o_orderkey < 1024 THEN o_orderkey || '.0 KB' WHEN o_orderkey < 1048576 THEN CAST(round(CAST(o_orderkey / 1024 AS DECIMAL(30, 12)), 1) AS DECIMAL(20, 1)) || ' MB' ELSE CAST(round(CAST(o_orderkey / 1048576 AS DECIMAL(36, 22)), 2) AS DECIMAL(20, 2)) || ' GB' END AS size,
      CASE WHEN o_orderkey < 100 THEN o_orderkey * 10 || ' ms' WHEN o_orderkey < 6000 THEN CAST(round(CAST(o_orderkey AS DECIMAL(20, 4)) / 100, 1) AS DECIMAL(20, 1)) || ' s' ELSE (o_orderkey * 10 // 60000) || ' m ' || (o_orderkey * 10 % 60000 // 1000) || ' s' END AS time FROM orders""",
    "locality_rate": "SELECT n_nationkey, CASE WHEN n_nationkey + n_regionkey > 0 THEN n_nationkey / (n_nationkey + n_regionkey) ELSE 1.0 END AS rate FROM nation",
    "json_path": "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') END AS k_string FROM events",
    "median_duration": "SELECT event_type, CAST(floor(median(floor(value))) AS BIGINT) AS median FROM events GROUP BY event_type",
    "text_unescape": r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all('\q' || chr(0) || text || '\n\\n\', '(?s)\\.|[^\\]+|\\'),
      lambda x: CASE x WHEN '\\' THEN '\' WHEN '\t' THEN chr(9) WHEN '\n' THEN chr(10) WHEN '\r' THEN chr(13) ELSE x END), '') AS plain FROM documents""",
    "json_first": "SELECT event_id, event_type AS k FROM events",
    "warc_pages": "SELECT url, html FROM pages WHERE page_id % 4 <> 1",
    "dump_pages": "SELECT url, html FROM pages",
    "page_file_edges": _WITH_PAGES + "SELECT source, target FROM page_edges",
    "edge_file": f"WITH {_EDGES} SELECT source, target FROM edges",
    "derived_edges": _DERIVED + "SELECT DISTINCT source, target FROM derived",
    "derived_edges_external": _DERIVED + "SELECT source, target FROM outward",
    "derived_resolved": _DERIVED + _INDEX.format("outward SEMI JOIN own USING (target)"),
    "derived_dangling": _DERIVED + _INDEX.format("outward ANTI JOIN own USING (target)"),
}

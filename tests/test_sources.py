"""Sources and sinks on small files, among them the golden archive."""

import gzip
import io
import json
import tarfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from refweave import cli
from refweave.functions import jsonpath
from refweave.operators import index
from refweave.operators.extract import pages_to_edges
from refweave.plans import jobs
from refweave.sources import edgelist, files, pagefile, sinks, synthetic, warc, wikidump

# A shop, its supplier and a blog, each on a site of its own; the index is worked out by hand.
PAGES = [
    ("http://shop.test/", "Text/HTML", """<a href=tea?id=4>own</a><a href="//blog.test/2020/a b">blank</a><a href="http://www.shop.test/cart">own, but for www</a>
      <A class=big HREF='http://Farm.test:80/leaf'>port</A><a href="tel:5">no page</a>"""),
    ("http://farm.test/leaf", "application/xhtml+xml", """<base href='http://blog.test/2020/'><a href="#top">nothing</a><a href="./">folder of the base</a><a href="http://SHOP.test">host in capitals</a><a href="http://shop.test/#end">the same</a>"""),
    ("http://blog.test/2020/", "text/html;charset=latin-1", """<a href="http://shop.test/?q=&quot;tea&quot;&amp;n=2">entities</a><a href='http://farm.test/leaf'>plain</a><a href="2019">own</a>"""),
    ("http://blog.test/feed", "application/rss+xml", "<a href='http://shop.test/'>no page</a>"),
]
GOLDEN = {
    "http://farm.test/leaf": ["http://blog.test/2020/", "http://shop.test/"],
    "http://blog.test/2020/": ["http://farm.test/leaf"],
    "http://shop.test/": ["http://farm.test/leaf"],
}
INSIDE = {"http://shop.test/tea?id=4", "http://www.shop.test/cart", "http://blog.test/2020/2019"}


def record(url, kind, body, kind_of="response", length=None):
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + body
    size = len(http) if length is None else length
    return f"WARC/1.0\r\nWARC-Type: {kind_of}\r\nWARC-Target-URI: {url}\r\nContent-Length: {size}\r\n\r\n".encode() + http + b"\r\n\r\n"


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "golden.warc.gz"
    path.write_bytes(b"".join(gzip.compress(record(u, k, b.encode())) for u, k, b in PAGES))
    return str(path)


def as_dict(found):
    return {r["target"]: r["sources"] for r in found.collect()}


def test_golden_archive(spark, archive):
    rows = warc.read(spark, archive)
    assert rows.count() == 4
    pages = warc.html_pages(rows)
    assert pages.count() == 3
    assert as_dict(index.backlinks(pages_to_edges(pages))) == GOLDEN
    inside = as_dict(index.backlinks(pages_to_edges(pages, include_internal=True)))
    assert set(inside) - set(GOLDEN) == INSIDE
    assert as_dict(index.backlinks(jobs.ingest(spark, "warc", archive))) == GOLDEN


def test_archive_rules():
    read = lambda *parts: list(warc.records(io.BytesIO(b"".join(parts))))
    good = record("u", "text/html", b"x")
    assert len(read(b"noise\r\n", good, good)) == 2
    assert len(read(good, record("u", "t", b"x", length="bad"), good)) == 1
    assert len(read(good, record("u", "t", b"x", length=-1), good)) == 1
    with pytest.raises(EOFError):
        read(record("u", "t", b"x", length=10_000))
    (_, http, payload), (_, none, whole) = read(good, record("u", "t", b"x", kind_of="request"))
    assert http == {"content-type": "text/html"} and payload == b"x" and none == {} and whole.startswith(b"HTTP/")
    assert warc.split_http(b"A: 1\n\nbody") == ({"a": "1"}, b"body") and warc.split_http(b"no end") == ({}, b"no end")
    big = read(record("u", "t", b"x" * (warc.MOST + 1)), good)
    assert big[0][2] == b"" and len(big) == 2
    assert [warc.charset(x) for x in ("text/html", 'text/html; charset="latin-1"; x', "charset=nonsense", "charset=")] == ["utf-8", "iso8859-1", "utf-8", "utf-8"]
    for name in ("hex", "rot13", "undefined", "zlib", "idna", "punycode"):
        assert warc.decoded(b"\xc3\xa9-a" if name != "idna" else b"\xff..", warc.charset(f"charset={name}"))
    assert warc.decoded("é".encode(), warc.charset("charset=hex")) == "é"


def test_archives_leave_workers_in_batches_of_bounded_bytes(spark):
    bodies = [f"{i}é".encode("latin-1") + b"x" * (1 << 20) for i in range(20)] + [b"", b"y"]
    files = [b"".join(record(f"u{i}", "text/html; charset=latin-1", b) for i, b in enumerate(bodies)), None, gzip.compress(record("z", "text/html", "é".encode()))]
    held = list(warc._parsed(iter([pa.record_batch([["a.warc", "b.warc", "c.WARC.gz"], files], names=["path", "content"])])))
    assert [r for b in held for r in zip(b["path"].to_pylist(), b["record"].to_pylist(), strict=True)] == [("a.warc", i) for i in range(22)] + [("c.WARC.gz", 0)]
    one = pa.concat_tables([pa.Table.from_batches([b]) for b in held]).combine_chunks().to_batches()[0]
    kinds = [dict(h)["content-type"] for h in one["http_headers"].to_pylist()]
    texts = list(warc._texts(iter([pa.record_batch([one["path"], kinds, one["payload"]], names=["url", "kind", "payload"])])))
    assert [h for b in texts for h in b["html"].to_pylist()] == [b.decode("latin-1") for b in bodies] + ["é"]
    assert min(len(held), len(texts)) > 3 and max(b.nbytes for b in held + texts) < 2 * warc.BATCH_BYTES
    small = [record(f"u{i}", "text/html", b"x") for i in range(50)]  # a batch for all files, not one each
    assert len(list(warc._parsed(iter([pa.record_batch([["a.warc"] * 50, small], names=["path", "content"])])))) == 1
    plan = warc.html_pages(warc.parse(spark.createDataFrame([("a.warc", bytearray(files[0]))], "path string, content binary")))
    assert plan.count() == 22 and "InPandas" not in plan._jdf.queryExecution().executedPlan().toString() + plan._jdf.queryExecution().optimizedPlan().toString()


def test_edge_lists(spark, tmp_path):
    lines = ["# c", "% c", "", "0\t11342", "0 11342", "0,11342", "0   7", "0 7 0.5", "5 5", " 1 2", "lonely", "3 "]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"9 8\n"))
    (tmp_path / "c.csv").write_text("1 1\n")
    paths = files.resolve(spark, str(tmp_path), "edges")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.txt", "b.txt.gz"]
    got = sorted(tuple(r) for r in edgelist.read(spark, *paths).collect())
    assert got == sorted([("0", "11342")] * 3 + [("0", "7")] * 2 + [("5", "5"), ("9", "8")])
    assert edgelist.malformed(spark, *paths).first()[0] == 3
    assert dict((r["source"], r["targets"]) for r in edgelist.adjacency(edgelist.read(spark, *paths)).collect())["0"] == ["11342"] * 3 + ["7"] * 2


def test_page_files(spark, tmp_path):
    deep = tmp_path / "bucket-0" / "sub-1"
    deep.mkdir(parents=True)
    (deep / "p.page").write_text("LINK nobody\nURL  http://a/ \nLINK http://b/ \nnoise\nLINK http://b/\nURL \nLINK http://c/\nURL http://d/\nLINK  \n")
    (deep / "p.txt").write_text("URL x\nLINK y\n")
    pages = pagefile.read(spark, str(tmp_path))
    assert sorted(tuple(r) for r in pagefile.edges(pages).collect()) == [("", "http://c/"), ("http://a/", "http://b/"), ("http://a/", "http://b/")]
    assert pagefile.counters(pages).first().asDict() == {"page_files": 1, "pages": 2, "links_emitted": 3}


def test_dump(spark, tmp_path):
    rows = [{"url": "https://w.org/wiki/A", "article_body": {"html": '<a href="/wiki/B">b</a><a href="/wiki/File:X">f</a><a href="/wiki/C?x=1">c</a><a href="./User_talk:Bob">u</a>'}}, {"url": "https://w.org/wiki/E"}, {"url": "https://w.org/wiki/B", "article_body": {"html": '<a href="/wiki/A">a</a>'}}]
    body = "\n".join(json.dumps(r) for r in rows).encode()
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for i, part in enumerate((body[:70], body[70:])):  # a line goes on in the next member
            info = tarfile.TarInfo(f"{i}.ndjson")
            info.size = len(part)
            tar.addfile(info, io.BytesIO(part))
    (tmp_path / "d.tar.gz").write_bytes(buffer.getvalue())
    (tmp_path / "cut.tgz").write_bytes(buffer.getvalue()[:-40])
    assert [r["url"] for r in wikidump.read(spark, str(tmp_path / "d.tar.gz")).collect()] == ["https://w.org/wiki/A", "https://w.org/wiki/B"]
    assert wikidump.read(spark, str(tmp_path / "cut.tgz")).count() <= 2
    for bad in (b"no gzip at all", gzip.compress(b"no tar file" * 100), buffer.getvalue()[:200] + b"xxxx" + buffer.getvalue()[204:]):
        with pytest.raises((tarfile.ReadError, OSError, zlib.error)):
            list(wikidump.articles(bad))
    assert list(wikidump.articles(b"")) == []
    want = {("https://w.org/wiki/A", "https://w.org/wiki/B"), ("https://w.org/wiki/A", "https://w.org/wiki/User_talk:Bob"), ("https://w.org/wiki/B", "https://w.org/wiki/A")}
    assert {tuple(r) for r in jobs.ingest(spark, "wikipedia", str(tmp_path / "d.tar.gz")).collect()} == want
    (tmp_path / "d.ndjson").write_bytes(body)
    assert {tuple(r) for r in jobs.ingest(spark, "wikipedia", str(tmp_path / "d.ndjson")).collect()} == want


def test_synthetic_graph_is_the_same_under_any_partitioning(spark):
    a = synthetic.generate(spark, 300, 4)
    assert sorted(a.collect()) == sorted(synthetic.generate(spark, 300, 4).repartition(3).collect())
    assert a.where("source = target").count() == 0 and a.count() > 1100
    fan = index.fan_in(synthetic.generate(spark, 300, 8, skew=1.0)).agg(F.max("fan_in")).first()[0]
    assert fan > 3 * index.fan_in(synthetic.generate(spark, 300, 8, skew=0)).agg(F.max("fan_in")).first()[0] / 2
    assert synthetic.generate(spark, 5, 0).count() == 0


def test_sinks_and_command_line(spark, archive, tmp_path, capsys, monkeypatch):
    out = str(tmp_path / "tsv")
    cli.main(["index", "--warc", archive, "--out", out, "--ordered"], spark)
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert sorted(lines) == sorted(f"{k}\t{' '.join(v)}" for k, v in GOLDEN.items())
    cli.main(["ingest", "--warc", archive, "--out", str(tmp_path / "edges")], spark)
    cli.main(["stats", "--extracted", str(tmp_path / "edges"), "--top", "1"], spark)
    said = capsys.readouterr().out
    assert "METRIC backlink_edges=4" in said and "METRIC backlink_keys=3" in said and "2\thttp://farm.test/leaf" in said
    monkeypatch.setenv("REFWEAVE_PAGES", "50")
    cli.main(["gen", "--out", str(tmp_path / "gen"), "--partitions", "4", "--links", "3"], spark)
    parts = spark.read.parquet(str(tmp_path / "gen"))
    assert parts.count() == 50 and set(parts.columns) == {"source", "targets", "part"}
    assert parts.where(F.col("part") != sinks.bucket(F.col("source"), 4)).count() == 0
    cli.main(["index", "--extracted", str(tmp_path / "gen"), "--out", str(tmp_path / "gen.tsv")], spark)
    want = index.tsv_lines(index.backlinks(synthetic.generate(spark, 50, 3)))
    assert sorted(spark.read.text(str(tmp_path / "gen.tsv")).collect()) == sorted(want.collect())
    cli.main(["run", "--warc", archive, "--out", str(tmp_path / "run")], spark)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "run" / "index")).collect()) == sorted(lines)


def test_lines_of_targets_in_several_chunks_are_those_of_whole_ones(spark):
    edges = synthetic.generate(spark, 300, 6)
    chunks = index.backlinks_in_chunks(edges, 5)
    assert chunks.where("chunk > 0").count() and sorted(index.joined(chunks).collect()) == sorted(index.backlinks(edges).collect())


def test_the_first_of_a_json_key_counts():
    first = jsonpath.first_string
    assert first('{"a":{"b":"x"},"a":{"b":"y"}}', "a.b") == first(' { "c" : [ {"]":1} , "}" ] , "a":{"b":"x" broken', "a.b") == "x"
    assert first('{"k":"a\\u0041\\n\\q\\ud83d\\ude00"}', "k") == "aA\nq\U0001f600"
    for bad in (None, "", "[]", "{}", '{"k":1}', '{"k"', '{"k":"open', '{"a" 1,"k":"x"}', '{"a":1 "k":"x"}', '{"k":1,"k":"x"}', '{"a":"b"}'):
        assert first(bad, "k") is None

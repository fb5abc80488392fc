"""Encyclopedia dumps: gzipped tar files of NDJSON members, or NDJSON on its own."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PAGES_HTML

# Fixed value: the longest line.
LONGEST = 32 << 20
#: What tarfile says of files that end early.
CUT = {"unexpected end of data", "truncated header", "empty file"}


def _lines(content: bytes) -> Iterator[bytes]:
    """Lines over all regular members; one may go on from a member into the next. A cut file ends early, without an error; what is
    no gzipped tar file, or a damaged one, is an error."""
    carry = b""
    try:
        with tarfile.open(fileobj=gzip.open(io.BytesIO(content)), mode="r|") as tar:
            for member in tar:
                if not member.isreg() and member.type != tarfile.CONTTYPE:
                    continue
                file = tar.extractfile(member)
                while file and (chunk := file.read(1 << 20)):
                    *whole, carry = (carry + chunk).split(b"\n")
                    yield from whole
                    if len(carry) > LONGEST:
                        raise ValueError("a line of the dump is too long")
    except EOFError:
        pass
    except tarfile.ReadError as e:
        if str(e) not in CUT:
            raise
    if carry:
        yield carry


def articles(content: bytes) -> Iterator[tuple[str, str]]:
    """Address and HTML of each article that has both."""
    for line in _lines(content):
        if len(line) < 2:
            continue
        try:
            row = json.loads(line)
        except ValueError:
            continue
        url = row.get("url") if isinstance(row, dict) else None
        body = row.get("article_body") if isinstance(row, dict) else None
        html = body.get("html") if isinstance(body, dict) else None
        if isinstance(url, str) and isinstance(html, str) and url and html:
            yield url, html


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """url, html of all articles of *.tar.gz and *.tgz files; one file is one task."""
    return parse(spark.read.format("binaryFile").load(list(paths)).where(F.lower("path").rlike(r"\.(tar\.gz|tgz)$")))


def parse(files: DataFrame) -> DataFrame:
    """url, html of all articles of packed dumps (content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                held, size = [], 0
                for url, html in articles(content):
                    held.append((url, html))
                    size += len(html)
                    if size > 8 << 20:
                        yield pd.DataFrame(held, columns=["url", "html"])
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["url", "html"])

    return files.select("content").mapInPandas(run, PAGES_HTML)


def read_ndjson(spark: SparkSession, *paths: str) -> DataFrame:
    """url, html of unpacked NDJSON files, which Spark can split."""
    rows = spark.read.schema("url string, article_body struct<html: string>").json(list(paths))
    return rows.select("url", F.col("article_body.html").alias("html")).where("url <> '' and html <> ''")

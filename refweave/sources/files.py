"""Input resolution: a file stands for itself, a folder for its own files of a kind, in order of name."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The endings of each kind of input.
KINDS = {"warc": [".warc", ".warc.gz"], "wikipedia": [".tar.gz", ".tgz", ".ndjson"], "edges": [".txt", ".txt.gz", ".edges", ".gz"]}


def resolve(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Files of path, by Hadoop's file systems, so that remote paths work too."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(at)
    if not status.isDirectory():
        return [path]
    names = [s.getPath().toString() for s in fs.listStatus(at) if s.isFile()]
    return sorted(n for n in names if n.lower().endswith(tuple(KINDS[kind])))

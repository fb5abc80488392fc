"""Schemas of the relations that sources, operators and sinks exchange. Nothing is inferred from data."""

from pyspark.sql.types import ArrayType, BinaryType, LongType, MapType, StringType, StructField, StructType

EDGES = StructType([StructField("source", StringType()), StructField("target", StringType())])
PAGES_HTML = StructType([StructField("url", StringType()), StructField("html", StringType())])
INDEX = StructType([StructField("target", StringType()), StructField("sources", ArrayType(StringType()))])
WARC = StructType([
    StructField("path", StringType()), StructField("record", LongType()),
    StructField("warc_headers", MapType(StringType(), StringType())),
    StructField("http_headers", MapType(StringType(), StringType())),
    StructField("payload", BinaryType()),
])
STATS = StructType([StructField(n, LongType()) for n in ("pages", "links_emitted", "backlink_keys", "backlink_edges", "max_fan_in", "distinct_sources")])

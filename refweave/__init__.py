"""refweave: a Spark-first engine for backlink (link-graph) indexes."""

__version__ = "0.1.0"

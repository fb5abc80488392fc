"""Command line: ingest, gen, index, run and stats. Flags also come from the environment, as REFWEAVE_MAX_PAGES for --maxPages."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession

from .operators.index import top_targets
from .plans import jobs
from .sources import sinks, synthetic

KINDS = ("prepared", "edges", "wikipedia", "warc", "parquet")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="refweave")
    top.add_argument("--verbose", action="store_true")
    top.add_argument("--quiet", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in (("ingest", "extract edges to Parquet"), ("index", "build the index, written as TSV"), ("run", "ingest and index: edges and TSV under --out"), ("stats", "print counters as METRIC lines")):
        one = sub.add_parser(name, help=text)
        for kind in KINDS:
            one.add_argument(f"--{kind}", action="append")
        one.add_argument("--extracted", help="edges that ingest wrote")
        one.add_argument("--includeInternal", action="store_true")
        one.add_argument("--maxPages", type=int)
        one.add_argument("--out")
        one.add_argument("--partitions", type=int)
        one.add_argument("--pagesPerFile", type=int, default=sinks.PAGES_PER_FILE)
        one.add_argument("--top", type=int)
        one.add_argument("--ordered", action="store_true")
    gen = sub.add_parser("gen", help="write a synthetic graph")
    for flag, kind, value in (("out", str, "build/synthetic"), ("pages", int, 20_000), ("partitions", int, 16), ("links", int, 10), ("pagesPerFile", int, 200), ("seed", int, 42), ("skew", float, 1.0)):
        gen.add_argument(f"--{flag}", type=kind, default=value)
    for p in sub.choices.values():  # what is not given on the command line comes from the environment
        for action in p._actions:
            value = os.environ.get("REFWEAVE_" + re.sub(r"([A-Z])", r"_\1", action.dest).upper())
            if value is not None and action.dest != "help":
                p.set_defaults(**{action.dest: value.lower() == "true" if action.nargs == 0 else (action.type or str)(value)})
    return top


def _edges(spark: SparkSession, args: argparse.Namespace):
    if args.extracted:
        return sinks.read_edges(spark, args.extracted)
    for kind in KINDS:
        if paths := getattr(args, kind):
            return jobs.ingest(spark, kind, *([paths] if isinstance(paths, str) else paths), include_internal=args.includeInternal, max_pages=args.maxPages)
    raise SystemExit("no input given")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("refweave").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR" if args.quiet else "WARN")
    if args.command == "gen":
        edges = synthetic.generate(spark, args.pages, args.links, args.seed, args.skew)
        sinks.write_partitions(edges, args.out, args.partitions, args.pagesPerFile)
        return
    edges = _edges(spark, args)
    if args.command == "ingest":
        if args.partitions:
            sinks.write_partitions(edges, args.out, args.partitions, args.pagesPerFile)
        else:
            sinks.write_edges(edges, args.out)
    elif args.command == "run":
        sinks.write_edges(edges, f"{args.out}/edges")
        sinks.write_tsv(jobs.index(spark, sinks.read_edges(spark, f"{args.out}/edges")), f"{args.out}/index", args.ordered)
    elif args.command == "index":
        sinks.write_tsv(jobs.index(spark, edges), args.out, args.ordered)
    else:
        for row in sinks.metric_lines(jobs.metrics(edges)).toLocalIterator():
            print(row["value"])
        for row in top_targets(edges, args.top or 0).toLocalIterator():
            print(row["fan_in"], row["target"], sep="\t")


if __name__ == "__main__":
    main(sys.argv[1:])

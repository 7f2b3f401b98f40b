"""python -m lodestone index|merge|search: the library from a shell."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from lodestone.operators import store
from lodestone.plans import engine
from lodestone.session import ship


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index", help="index spec files")
    one.add_argument("-o", "--output-dir", default=".")
    one.add_argument("specs", nargs="+")
    many = commands.add_parser("merge", help="make one index of several")
    many.add_argument("-o", "--output", default="merged.index")
    many.add_argument("stores", nargs="+")
    find = commands.add_parser("search", help="search an index")
    find.add_argument("-d", "--index", required=True)
    find.add_argument("-f", "--file")
    find.add_argument("-s", "--symbol")
    find.add_argument("phrases", nargs="*")
    args = parser.parse_args(argv)
    if args.command == "search" and not (args.phrases or args.symbol is not None or args.file is not None):
        parser.error("nothing to search for")
    if args.command == "search" and "://" not in args.index and not os.path.isdir(args.index):
        print(f"no index at {args.index}", file=sys.stderr)
        return 1
    spark = ship(SparkSession.builder.appName("lodestone").getOrCreate())
    if args.command == "index":
        stem = os.path.splitext(os.path.basename(args.specs[0]))[0]
        bad = engine.index_specs(spark, args.specs, os.path.join(os.path.abspath(args.output_dir), stem + ".index"))
        for row in bad.select("spec_file").toLocalIterator():
            print(f"not a spec: {row['spec_file']}", file=sys.stderr)
    elif args.command == "merge":
        engine.merge_stores(spark, args.stores, args.output)
    else:
        relations = store.read(spark, args.index)
        results = engine.search_store(relations, args.phrases, args.symbol, args.file)
        for row in engine.printed(results, relations["document"]).toLocalIterator():
            print(row["line_text"])
    return 0


if __name__ == "__main__":
    sys.exit(main())

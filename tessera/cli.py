"""Command line: index, outline, get, search, pack."""

from __future__ import annotations

import argparse
import sys

from tessera import api
from tessera.operators.pack import Packer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("dir", nargs="?", default=".")
    sub.add_parser("outline").add_argument("path")
    sub.add_parser("get").add_argument("symbol_or_path")
    sub.add_parser("search").add_argument("query")
    k = sub.add_parser("pack")
    k.add_argument("dir", nargs="?", default=".")
    k.add_argument("-f", "--format", default="xml")
    k.add_argument("-m", "--max-tokens", type=int)
    for flag in ("no-file-summary", "no-files", "remove-comments", "remove-empty-lines", "truncate-base64"):
        k.add_argument(f"--{flag}", action="store_true")
    k.add_argument("--include", action="append")
    k.add_argument("--ignore", action="append")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if a.command == "index":
            api.index(spark, a.dir)
            print("Indexing complete")
        elif a.command == "outline":
            print(api.outline(spark, ".", a.path))
        elif a.command == "get":
            print(api.get(spark, ".", a.symbol_or_path))
        elif a.command == "search":
            for i in api.search(spark, ".", a.query):
                print(i)
        else:
            packer = Packer(a.format, a.max_tokens, a.no_file_summary, a.no_files, a.remove_comments, a.remove_empty_lines, a.truncate_base64)
            print(api.pack(spark, a.dir, packer, a.include, a.ignore))
    except api.NotFound as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

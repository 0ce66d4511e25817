"""`python -m foliospark.cli ACTION ...`: the actions from a command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.report import error_lines
from .plans import actions as A


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliospark")
    p.add_argument("action", choices=["show-config", "check", "translate", "fix-links"])
    p.add_argument("--source-dir", required=True)
    p.add_argument("--target", action="append", default=[], metavar="LOCALE=DIR")
    p.add_argument("--include", default=A.DEFAULT_INCLUDE)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--field", action="append", default=[])
    p.add_argument("--limit", type=int, default=2_147_483_647)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--parallelism", type=int, default=4)
    p.add_argument("--token")
    o = p.parse_args(args)
    targets = [(t.partition("=")[0], t.partition("=")[2]) for t in o.target]
    c = A.Config(o.source_dir, targets, o.include, o.exclude, o.field, o.limit, o.dry_run, o.parallelism, token=o.token)
    if o.action == "show-config":
        for k, v in A.show_config(c):
            print(f"{k}: {v}")
        return 0
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    if o.action == "check":
        git, links, totals = A.check(spark, c)
        for rows in (git, links):
            for r in error_lines(rows).orderBy("path", "line").toLocalIterator():
                print(r.line)
        print(totals.first().asDict())
        return 0 if totals.first().success else 1
    if o.action == "translate":
        for r in A.translate_all(spark, c).collect():
            print(r.asDict())
        return 0
    corrected, left = A.fix_links(spark, c)
    for r in error_lines(left).orderBy("path", "line").toLocalIterator():
        print(r.line)
    print(f"{corrected.where('writable').count()} files written")
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""python -m waymark: list queries, run one of them or a command over a folder of tables, write settings or an example."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import catalogue
from .runs import commands, results, settings
from .sources import example


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="waymark")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="names of all queries and commands")
    q = sub.add_parser("query", help="one query, written as a table")
    q.add_argument("name")
    q.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    c = sub.add_parser("command", help="a set of summary queries, saved as JSON")
    c.add_argument("name", choices=[*commands.COMMANDS, "all"])
    for x in (q, c):
        x.add_argument("--data", required=True)
        x.add_argument("--out", required=True)
    c.add_argument("--config")
    t = sub.add_parser("tidy", help="all saved tables as one CSV")
    t.add_argument("--out", required=True)
    t.add_argument("--csv", required=True)
    sub.add_parser("template", help="all settings, as comments")
    e = sub.add_parser("example", help="a commute table made up from hashes")
    e.add_argument("--out", required=True)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.what == "list":
        print("\n".join([*sorted(catalogue.queries()), *(f"command {c}" for c in commands.COMMANDS)]))
        return 0
    if a.what == "template":
        print(results.template(), end="")
        return 0
    if a.what == "tidy":
        print(commands.tidy(a.out, a.csv))
        return 0
    spark = spark or SparkSession.builder.appName("waymark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "example":
        example.write(spark, a.out)
    elif a.what == "query":
        if a.name not in catalogue.queries():
            raise ValueError(settings._hint(a.name, catalogue.queries()))
        found = catalogue.queries()[a.name](spark, a.data).write.mode("overwrite").format(a.format)
        (found.option("header", True) if a.format == "csv" else found).save(a.out)
    elif a.name == "all":
        print(json.dumps(commands.run_all(spark, a.data, a.out), indent=1))
    else:
        commands.run(spark, a.name, a.data, a.out, given=settings.read(a.config) if a.config else None)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line over the API: python -m quillspark COMMAND ...."""

from __future__ import annotations

import argparse

from . import api
from .operators import inventory, profile
from .plans import lake as lakes
from .sources import text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {
        "systems": ["root"], "families": ["root", "system"], "partitions": ["root", "system", "family"], "describe": ["root", "view"], "sql": ["root", "statement"], "views": ["root"],
        "export": ["root", "system", "family", "out"], "profile": ["path"], "explore": ["listing"], "size": ["root"], "references": ["root"],
    }.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        s.add_argument("--limit", type=int, default=50)
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if a.command in ("profile",):
        profile.statistics(profile.frequencies(text.accept(spark, a.path))).show(a.limit, truncate=60)
    elif a.command == "explore":
        api.explore(inventory.facts(spark.read.text(a.listing).withColumnRenamed("value", "path"))).show(a.limit)
    elif a.command == "references":
        lakes.reference_tables(spark, a.root).show(a.limit, truncate=60)
    else:
        lake = api.open_lake(spark, a.root)
        if a.command == "systems":
            print(*lake.systems(), sep="\n")
        elif a.command == "families":
            print(*lake.families(a.system), sep="\n")
        elif a.command == "partitions":
            print(*lake.partitions(a.system, a.family), sep="\n")
        elif a.command == "views":
            print(*lake.views(), sep="\n")
        elif a.command == "size":
            print(lake.bytes_on_disk())
        elif a.command == "describe":
            print(*(f"{c}\t{t}" for c, t in lake.describe(a.view)), sep="\n")
        elif a.command == "sql":
            lake.sql(a.statement).show(a.limit, truncate=60)
        elif a.command == "export":
            print(api.export(lake.family(a.system, a.family), a.out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

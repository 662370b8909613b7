"""Run a query by name: ``python -m lodestore list`` or ``python -m lodestore run NAME --data FOLDER --out FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import registry


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if it was done, 2 for a name that is no query's."""
    parser = argparse.ArgumentParser(prog="lodestore")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query and write or show its rows")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", help="folder for the result; without it the first rows are shown")
    run.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    asked = parser.parse_args(given)
    queries = registry.queries()
    if asked.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if asked.name not in queries:
        print(f"no query is called {asked.name}")
        return 2
    rows = queries[asked.name](spark or SparkSession.builder.appName("lodestore").getOrCreate(), asked.data)
    if asked.out:
        rows.write.format(asked.format).option("header", True).save(asked.out)
    else:
        rows.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

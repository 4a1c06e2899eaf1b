"""Command line: analyse a source tree and write its tables."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from archlens.plans import incremental
from archlens.plans.session import Config, Session
from archlens.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="archlens")
    out.add_argument("--root", default=".", help="folder of the project")
    out.add_argument("--app-dir", default="app", help="folder of the pages, below the root")
    out.add_argument("--output", default=".generated/archlens", help="folder of the tables")
    out.add_argument("--no-cache", action="store_true", help="analyse even if no file has changed")
    return out


def analyse(spark: SparkSession, root: str, app_dir: str, output: str, cached: bool = True) -> str:
    """Write all tables unless no file has changed since the last run, of whose facts those of unchanged files are kept; ``written`` or ``unchanged``."""
    config = Config(app_dir=app_dir)
    found = files.scan(spark, root, config.include, config.exclude)
    kept = incremental.Incremental(Session(spark, config), f"{output}/facts")
    first = kept.table.batch < 0
    analysed, removed = kept.update(found) if cached else (kept.rebuild(found), 0)
    if cached and not first and not analysed and not removed:
        return "unchanged"
    tables = kept.session.assemble(kept.table.read())
    sinks.write_tables(tables, output)
    sinks.write_summary(tables["summary"], f"{output}/summary.json")
    return "written"


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("archlens").getOrCreate()
    print(analyse(spark, a.root, a.app_dir, a.output, not a.no_cache))


if __name__ == "__main__":
    main()

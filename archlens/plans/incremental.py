"""Runs that read again only the files that have changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.operators.keep import settled
from archlens.plans.session import Session, Tables
from archlens.sources import snapshots


@dataclass
class Run:
    """The tables of a run, how many files' texts it analysed and how many files went."""

    tables: Tables
    analysed: int
    removed: int


class Incremental:
    """The facts of every file, kept in a folder by path and with the hash of its text.

    ``update`` compares hashes, analyses new and changed files, replaces or drops their rows
    and publishes the result as one version (see ``snapshots.KeyedTable``); two writers can't
    mix.  ``run`` then joins the facts of all files, changed or not.
    """

    def __init__(self, session: Session, folder: str, buckets: int = 64):
        self.session = session
        self.table = snapshots.KeyedTable(session.spark, folder, ["file"], buckets)

    def update(self, files: DataFrame) -> tuple[int, int]:
        """Bring the facts up to date with files (path, content); how many were analysed and how many removed."""
        last = self.table.batch
        if last < 0:
            facts = settled(self.session.facts(files))
            self.table.merge(facts, 0)
            return facts.count(), 0
        known = self.table.read().select(F.col("file").alias("path"), "hash")
        todo = snapshots.changed(files, known)
        gone = settled(known.join(files.select("path"), "path", "left_anti").select(F.col("path").alias("file")))
        facts = settled(self.session.facts(todo))
        analysed, removed = facts.count(), gone.count()
        if analysed or removed:
            self.table.merge(facts, last + 1, gone)
        return analysed, removed

    def rebuild(self, files: DataFrame) -> int:
        """Analyse all files whatever is known of them; how many."""
        facts = settled(self.session.facts(files))
        known = self.table.read().select("file") if self.table.batch >= 0 else None
        self.table.merge(facts, self.table.batch + 1, known)
        return facts.count()

    def run(self, files: DataFrame, runtime: DataFrame | None = None) -> Run:
        analysed, removed = self.update(files)
        return Run(self.session.assemble(self.table.read(), runtime), analysed, removed)

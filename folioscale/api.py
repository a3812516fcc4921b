"""The engine's services over a folder of tables (API-01, API-02, API-05 to API-07).

    python -m folioscale.api FOLDER candidates --keyword 灯笼
    python -m folioscale.api FOLDER status | sources | missing --job ID
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import text as X
from .operators import health, journal, present, ranking
from .session import table
from .sources import capability, readers


@dataclass(frozen=True)
class Config:
    """Limits of the services; values out of range are errors (API-06)."""

    limit: int = 20
    most_attempts: int = 12
    same_errors: int = 3
    failures: int = 6
    response_chars: int = 4000

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive whole number, not {value!r}")


class Engine:
    """Everything returns a DataFrame; nothing is collected here."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None):
        self.spark, self.folder, self.config = spark, folder, config or Config()

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def import_sources(self, text: str) -> DataFrame:
        """Definitions from a file's text, with what they support and why not."""
        df = readers.source_definitions(self.spark.createDataFrame([(text,)], "text string")).where("source is not null")
        return capability.strategy(capability.family(capability.capability(capability.normalised(df))))

    def import_clean_rules(self, text: str) -> DataFrame:
        """Clean rules from JSON, or else from lines."""
        df = self.spark.createDataFrame([(text,)], "text string")
        return readers.clean_rules_json(df) if text.lstrip()[:1] in ("{", "[") else readers.clean_rules_text(df)

    def _some(self, df: DataFrame, ids: Sequence[str] | None) -> DataFrame:
        """JN-06: the rows of the given sources; all if none are given."""
        ids = [i.strip() for i in ids or () if i.strip()]
        return df.where(F.col("source_id").isin(ids)) if ids else df

    def stats(self, ids: Sequence[str] | None = None) -> DataFrame:
        """SRC-17: what the searches of the sources have been like."""
        return self._some(self._table("search_source_stats"), ids)

    def sources(self, offset: int = 0, limit: int | None = None, include_disabled: bool = True, ids: Sequence[str] | None = None) -> DataFrame:
        """SRT-04, LIM-04, SRC-15: a page of the sources, enabled ones first."""
        rows = self._some(self._table("book_source").where(F.lit(include_disabled) | F.col("enabled")), ids)
        return present.page(rows, [F.when(F.col("enabled"), 0).otherwise(1), F.coalesce("name", F.lit("")), F.col("source_id")], offset, limit or self.config.limit)

    def candidates(self, keyword: str, author: str = "", limit: int | None = None, health: DataFrame | None = None) -> DataFrame:
        """The ranked candidates of a keyword; those that cannot be taken come last, with the reason.

        health: the stages' states of each source (``operators.health.by_stage``); without it the search counters speak.
        """
        hits = self._table("search_hit").where(F.contains(X.compare_key(F.col("title")), X.compare_key(F.lit(keyword)))).withColumn("match_keyword", F.lit(keyword))
        sources, stats = self._table("book_source"), self._table("search_source_stats")
        sources = sources.withColumn("extractor", F.lit(None).cast("string")) if "extractor" not in sources.columns else sources
        searched = stats.select("source_id", ranking.runtime_state({k: F.col(k) for k in ("successes", "failures")}).alias("search"), *(F.lit(None).cast("string").alias(s) for s in ("preflight", "download")))
        got = ranking.candidates(hits, sources, searched if health is None else health, author=F.lit(author))
        return got.where(F.col("position") <= present.clamp(limit or self.config.limit))

    def status(self) -> DataFrame:
        return journal.status(self._table("job"))

    def missing(self, job: str | None = None) -> DataFrame:
        got = journal.missing(self._table("job"))
        return got if job is None else got.where(F.col("job_id") == job)

    def assemble(self, path: str, job: str | None = None) -> None:
        """The texts of complete jobs as files."""
        jobs = self._table("job")
        sinks.write_text(journal.assembled(jobs if job is None else jobs.where(F.col("job_id") == job)), path)

    def jobs(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """A page of the jobs with their status, in the order of their names."""
        return present.page(self.status(), [F.col("job_id")], offset, limit or self.config.limit)

    def resume(self, store: DataFrame, job: str | None = None, path: str | None = None) -> DataFrame:
        """STM-04: what going on with the jobs (or one) appends to their journals; written to ``path`` as JSON lines if given."""
        jobs = self._table("job")
        got = journal.resumed(jobs if job is None else jobs.where(F.col("job_id") == job), store)
        if path:
            sinks.append_journal(got, path)
        return got

    def health_counts(self, events: DataFrame) -> DataFrame:
        return health.state_counts(self.source_health(events))

    def import_summary(self, text: str) -> DataFrame:
        """SRC-10: how many definitions a file holds, and how many can be searched and downloaded."""
        return capability.import_counts(self.import_sources(text))

    def source_health(self, events: DataFrame) -> DataFrame:
        return health.with_defaults(self._table("book_source").select("source_id"), health.health(events))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="folioscale")
    p.add_argument("folder")
    p.add_argument("what", choices=["candidates", "status", "sources", "missing"])
    p.add_argument("--keyword", default="")
    p.add_argument("--author", default="")
    p.add_argument("--job")
    p.add_argument("--limit", type=int, default=20)
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.appName("folioscale").getOrCreate(), a.folder, Config(limit=a.limit))
    df = {"candidates": lambda: engine.candidates(a.keyword, a.author), "status": engine.status, "sources": engine.sources, "missing": lambda: engine.missing(a.job)}[a.what]()
    for row in df.limit(a.limit).toJSON().collect():
        print(row)


if __name__ == "__main__":
    main()

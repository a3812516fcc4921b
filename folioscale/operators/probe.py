"""Probes and attempts as plans: what would be tried, in which order, and where it ends
(STM-03, STM-07, LIM-07, AGG-13, SRC-19, SNK-07, SRT-05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls


def attempts(candidates: DataFrame, group: str, order: Sequence[Column], ok: Column, most: int = 12) -> DataFrame:
    """STM-07: of each group's ranked candidates those that are tried: up to the first success, ``most`` at the utmost.

    attempt_index counts from 0; outcome is started for the success, failed before it.
    """
    w = Window.partitionBy(group).orderBy(*order)
    df = candidates.withColumn("attempt_index", (F.row_number().over(w) - 1).cast("int")).where(F.col("attempt_index") < most).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    before = F.max(F.col("_ok").cast("int")).over(Window.partitionBy(group).orderBy("attempt_index").rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", F.coalesce(before, F.lit(0))).where("_before = 0").withColumn("outcome", F.when(F.col("_ok"), "started").otherwise("failed")).drop("_ok", "_before")


def run_status(tried: DataFrame, group: str) -> DataFrame:
    """STM-07: how each group ended: (attempts, status)."""
    return tried.groupBy(group).agg(F.count("*").alias("attempts"), F.when(F.max((F.col("outcome") == "started").cast("int")) == 1, "started").otherwise("exhausted").alias("status"))


def probe_events(sources: DataFrame, found: DataFrame, planned: DataFrame, sampled: DataFrame, min_length: int = 1) -> DataFrame:
    """STM-03: the stage events of a probe: search, then preflight, then a one-chapter sample.

    sources: (source_id, supports_search, supports_download); found, planned: (source_id, n);
    sampled: (source_id, length). A stage that is not supported says so and ends the probe there, and so
    does a stage without result (FLT-13: a sample below ``min_length`` is none).
    """
    n = lambda df, name: df.select("source_id", F.col(df.columns[1]).alias(name))
    df = sources.join(n(found, "_found"), "source_id", "left").join(n(planned, "_planned"), "source_id", "left").join(n(sampled, "_length"), "source_id", "left")
    search = F.when(~F.coalesce("supports_search", F.lit(False)), "unsupported").when(F.coalesce("_found", F.lit(0)) > 0, "healthy").otherwise("broken")
    plan = F.when(search != "healthy", F.lit(None)).when(~F.coalesce("supports_download", F.lit(False)), "unsupported").when(F.coalesce("_planned", F.lit(0)) > 0, "healthy").otherwise("broken")
    sample = F.when(plan != "healthy", F.lit(None)).when(plan.isNotNull(), F.when(F.coalesce("_length", F.lit(0)) >= min_length, "healthy").otherwise("broken"))
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), c.alias("state")) for s, c in (("search", search), ("preflight", plan), ("download", sample))))
    return df.select("source_id", F.explode(F.filter(stages, lambda x: x["state"].isNotNull())).alias("e")).select("source_id", "e.stage", "e.state")


def within_time(outcomes: DataFrame, run: str, order: Sequence[str], elapsed: str, budget: float) -> DataFrame:
    """LIM-07 on recorded times: each outcome as completed, timed out (begun within the budget) or unsearched."""
    w = Window.partitionBy(run).orderBy(*order)
    end = F.sum(elapsed).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return outcomes.withColumn("progress", F.when(end <= budget, "completed").when(end - F.col(elapsed) < budget, "timed_out").otherwise("unsearched"))


def run_summary(outcomes: DataFrame, run: str, candidates: DataFrame, stopped: Column) -> DataFrame:
    """AGG-13: how each search run went: sources to ask, asked, done, with hits, timed out, not asked, and why it ended.

    outcomes: (run, source_id, progress, error, hits) as ``within_time`` marks them; candidates: (run, sources,
    skipped); stopped: whether the run had its exact hits by then.
    """
    at = lambda p: F.count_if(F.col("progress") == p)
    got = outcomes.groupBy(run).agg(at("completed").alias("completed_sources"), F.count_if((F.col("progress") == "completed") & F.col("error").isNotNull()).alias("_errors"), at("timed_out").alias("timed_out_source_count"), F.sum("hits").alias("result_count"), F.max(stopped.cast("int")).alias("_stopped"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = candidates.join(got, run, "left").withColumns({"completed_sources": n("completed_sources"), "timed_out_source_count": n("timed_out_source_count"), "result_count": n("result_count")})
    asked = F.col("completed_sources") + F.col("timed_out_source_count")
    early = F.coalesce("_stopped", F.lit(0)) == 1
    reason = F.when(F.col("timed_out_source_count") > 0, "time_budget").when(early, "exact_match_limit").otherwise("")
    return out.select(
        run, F.col("sources").alias("candidate_sources"), "skipped_sources", asked.alias("searched_sources"), "completed_sources", F.greatest(F.lit(0), F.col("completed_sources") - n("_errors")).alias("successful_sources"),
        "timed_out_source_count", (F.col("sources") - asked).alias("unsearched_source_count"), (reason != "").alias("partial"), (reason == "exact_match_limit").alias("early_stopped"), reason.alias("stop_reason"), "result_count",
    )


def searches(cached_hits: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """SRC-19, SRT-05: the kept searches, newest first, with how many items each has; only those of ``ids`` if given.

    cached_hits: (search_id, item, at, ...).
    """
    df = cached_hits if ids is None else cached_hits.where(F.col("search_id").isin(list(ids)))
    return df.groupBy("search_id").agg(F.max("at").alias("at"), F.count("*").alias("items")).orderBy(F.col("at").desc(), "search_id")


def picked(cached_hits: DataFrame, search_id: str, item: int) -> DataFrame:
    """SRC-19: one item of a kept search; an index outside of it gives no row."""
    return cached_hits.where((F.col("search_id") == search_id) & (F.col("item") == item))


def cached(hits: DataFrame, search: str, order: Sequence[str]) -> DataFrame:
    """SNK-07, SRC-19: the hits of each search numbered as they are kept, under an id made of the search's key and its hash."""
    id = F.concat(X.key(F.col(search)), F.lit("-"), urls.short_hash(F.coalesce(F.col(search), F.lit(""))))
    return hits.withColumn("search_id", id).withColumn("item", (F.row_number().over(Window.partitionBy("search_id").orderBy(*order)) - 1).cast("int"))

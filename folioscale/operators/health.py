"""Rolling statistics of sources: folds of outcome events (AGG-01 to AGG-06, JN-07, JN-08, FLT-14 to FLT-16, MTH-01).

An event is (source_id, stage, at, id, ok, elapsed_ms, error, note, mark, metadata). An event with a mark
("unsupported" or "unknown") sets the state without being an attempt. Counters and states are mergeable
aggregates, so a source that a third of all events belong to costs no more than its share. The mean that is
rounded at each step (AGG-01) depends on the order of all its values and cannot be merged;
``rolling_means`` streams the sorted events of a source through one task in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import ship

STAGES = ["search", "preflight", "download"]
TIMEOUT = r"(?i)timeout|timed out|超时"
#: HTTP states and words of reasons that are worth another try. Fixed values.
RETRY = r"\b(408|425|429|500|502|503|504)\b|(?i)reset|refused|temporar|unreachable|timed out|timeout"
#: Words of the classes of errors, in the order they are tried. Fixed values.
ERROR_WORDS = [("timeout", ("timeout", "timed out", "超时")), ("network", ("network", "网络")), ("preflight_rule_toc", ("目录", "ruletoc")), ("http", ("http ",))]


def is_timeout(error: Column) -> Column:
    """FLT-14."""
    return F.coalesce(error.rlike(TIMEOUT), F.lit(False))


def error_class(error: Column, exception: Column | None = None) -> Column:
    """FLT-15: timeout, network, preflight_rule_toc or http by the error's words, or else the exception's name, or "error"; null for no error."""
    low = F.lower(error)
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for name, words in ERROR_WORDS:
        found = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            found = found | F.contains(low, F.lit(w))
        out = out.when(found, name)
    named = F.lit(None).cast("string") if exception is None else X.blank_to_null(F.lower(exception))
    return out.otherwise(F.coalesce(named, F.lit("error")))


def retryable(error: Column) -> Column:
    """FLT-16."""
    return F.coalesce(error.rlike(RETRY), F.lit(False))


def elapsed(c: str = "elapsed_ms") -> Column:
    """Negative and missing times count as 0."""
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def mean3(c: Column) -> Column:
    """MTH-01: a mean in three decimals, ties to even."""
    return F.bround(F.avg(c), 3)


def stats(events: DataFrame) -> DataFrame:
    """AGG-02: a row for each source: counters, means of elapsed and of successful milliseconds, last times.

    Means are of all values, rounded once.
    """
    ok, ms = F.coalesce("ok", F.lit(False)), elapsed()
    return events.groupBy("source_id").agg(
        F.count("*").alias("attempts"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.count_if(~ok & is_timeout(F.col("error"))).alias("timeouts"),
        mean3(ms).alias("avg_duration_ms"), F.coalesce(mean3(F.when(ok, ms)), F.lit(0.0)).alias("avg_success_ms"), F.max(F.when(ok, F.col("at"))).alias("last_success_at"), F.max(F.when(~ok, F.col("at"))).alias("last_failure_at"),
    )


def state(successes: Column, failures: Column, last_ok: Column) -> Column:
    """AGG-03, AGG-04: after a success healthy; after a failure degraded if at least as many succeeded, or else broken."""
    return F.when(last_ok, "healthy").when((successes > 0) & (failures <= successes), "degraded").otherwise("broken")


FIELDS = ["state", "attempts", "successes", "failures", "timeouts", "avg_ms", "last_success_at", "last_failure_at", "last_error", "note"]


def health(events: DataFrame) -> DataFrame:
    """AGG-03 to AGG-05: a row for each (source, stage): state, counters, mean, times, last error and note.

    The last event decides: a success clears the error and sets its note, a failure clears the note, a mark
    sets state and note, and clears the error.
    """
    for c in ("note", "mark"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    marked = F.col("mark").isNotNull()
    tried, ok, when = ~marked, F.coalesce("ok", F.lit(False)) & ~marked, F.struct("at", "id")
    bad = tried & ~ok
    out = events.groupBy("source_id", "stage").agg(
        F.count_if(tried).alias("attempts"), F.count_if(ok).alias("successes"), F.count_if(bad).alias("failures"), F.count_if(bad & is_timeout(F.col("error"))).alias("timeouts"), F.coalesce(mean3(F.when(tried, elapsed())), F.lit(0.0)).alias("avg_ms"),
        F.max(F.when(ok, F.col("at"))).alias("last_success_at"), F.max(F.when(bad, F.col("at"))).alias("last_failure_at"), F.max_by(F.struct(ok.alias("ok"), "mark", "error", "note"), when).alias("_last"),
    )
    last = F.col("_last")
    return out.select(
        "source_id", "stage", F.coalesce(last["mark"], state(F.col("successes"), F.col("failures"), last["ok"])).alias("state"), "attempts", "successes", "failures", "timeouts", "avg_ms", "last_success_at", "last_failure_at",
        F.when(~last["ok"] & last["mark"].isNull(), last["error"]).alias("last_error"), F.when(last["ok"] | last["mark"].isNotNull(), F.coalesce(last["note"], F.lit(""))).otherwise("").alias("note"),
    )


def metadata(events: DataFrame) -> DataFrame:
    """AGG-03: (source_id, stage, key, value): of each metadata key the last value written; none is ever removed."""
    return events.where("metadata is not null").select("source_id", "stage", "at", "id", F.explode("metadata")).groupBy("source_id", "stage", "key").agg(F.max_by("value", F.struct("at", "id")).alias("value"))


def with_defaults(ids: DataFrame, health: DataFrame) -> DataFrame:
    """SRC-16, JN-08: a row for each source and stage, unknown where nothing happened."""
    every = ids.select("source_id", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    filled = {"state": F.lit("unknown"), **dict.fromkeys(("attempts", "successes", "failures", "timeouts"), F.lit(0).cast("bigint")), "avg_ms": F.lit(0.0), "note": F.lit("")}
    joined = every.join(health, ["source_id", "stage"], "left")
    return joined.select("source_id", "stage", *(F.coalesce(c, filled[c]).alias(c) if c in filled else F.col(c) for c in FIELDS))


def state_counts(rows: DataFrame) -> DataFrame:
    """AGG-06."""
    return rows.groupBy("stage", F.coalesce("state", F.lit("unknown")).alias("state")).agg(F.count("*").alias("n"))


def by_stage(rows: DataFrame) -> DataFrame:
    """JN-07: the states of a source's stages side by side."""
    return rows.groupBy("source_id").pivot("stage", STAGES).agg(F.first("state"))


def rolling_means(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """AGG-01: (source_id, n, mean): the mean of each source, rounded to 3 digits (ties to even) after every event."""
    ship(events.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, mean, out = None, 0, 0.0, []
        for b in batches:
            for source, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n and source != at:
                    out.append((at, n, mean))
                    n, mean = 0, 0.0
                at, n = source, n + 1
                mean = round(ms if n <= 1 else (mean * (n - 1) + ms) / n, 3)
        if n:
            out.append((at, n, mean))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64()))], names=["source_id", "n", "mean"])

    rows = events.select("source_id", elapsed().alias("ms"), "at", "id")
    rows = rows.repartition(partitions, "source_id") if partitions else rows.repartition("source_id")
    return rows.sortWithinPartitions("source_id", "at", "id").select("source_id", "ms").mapInArrow(run, "source_id string, n bigint, mean double")

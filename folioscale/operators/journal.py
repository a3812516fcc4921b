"""Event-sourced jobs: replay, status, missing work, assembly, streaks
(AGG-09 to AGG-11, JN-03, JN-09, SNK-04, SNK-05, SNK-09, STM-04, STM-05, WIN-04 to WIN-06, WIN-08, SET-06).

A journal is a table of manifest, state, chapter and error records; ``order`` says which came later.
Status never reads the chapters' text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def chapters(journal: DataFrame, job: str = "job_id", order: str = "rec_id", keep: tuple[str, ...] = ("title", "url")) -> DataFrame:
    """AGG-09, WIN-08: of each (job, index) the last chapter record; records without an index are no chapters."""
    got = journal.where((F.col("kind") == "chapter") & F.col("index").isNotNull())
    return got.groupBy(job, "index").agg(F.max(order).alias(order), *(F.max_by(c, order).alias(c) for c in keep))


def open_errors(journal: DataFrame, job: str = "job_id", order: str = "rec_id") -> DataFrame:
    """AGG-09: of each (job, index) the last error, unless a chapter came after it."""
    got = journal.where(F.col("kind").isin("chapter", "error") & F.col("index").isNotNull())
    last = got.groupBy(job, "index").agg(
        F.max(F.when(F.col("kind") == "error", F.col(order))).alias(order), F.max(F.when(F.col("kind") == "chapter", F.col(order))).alias("_done"), F.max_by("error", F.when(F.col("kind") == "error", F.col(order))).alias("error"), F.max_by("attempt", F.when(F.col("kind") == "error", F.col(order))).alias("attempt")
    )
    return last.where(F.col(order).isNotNull() & (F.col("_done").isNull() | (F.col("_done") < F.col(order)))).drop("_done")


def manifests(journal: DataFrame, job: str = "job_id", order: str = "rec_id", keep: tuple[str, ...] = ("book_name", "output_filename", "chapters")) -> DataFrame:
    """AGG-09: of each job the first manifest."""
    return journal.where(F.col("kind") == "manifest").groupBy(job).agg(*(F.min_by(c, order).alias(c) for c in keep))


def status(journal: DataFrame, job: str = "job_id", order: str = "rec_id", errors: int = 10) -> DataFrame:
    """AGG-10, AGG-11: a row for each job: state, counts, and its first open errors.

    A job without a manifest has the state "broken".
    """
    heads = manifests(journal, job, order, ("book_name", "chapters")).withColumn("total", F.coalesce(F.size("chapters"), F.lit(0))).drop("chapters")
    states = journal.where(F.col("kind") == "state").groupBy(job).agg(F.max_by("state", order).alias("state"))
    done = chapters(journal, job, order, ()).groupBy(job).agg(F.count("*").alias("completed"))
    broken = open_errors(journal, job, order)
    failed = broken.groupBy(job).agg(F.count("*").alias("failed"))
    top = broken.withColumn("_n", F.row_number().over(Window.partitionBy(job).orderBy("index"))).where(F.col("_n") <= errors)
    shown = top.groupBy(job).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "error"))), lambda e: F.concat(e["index"].cast("string"), F.lit(":"), F.coalesce(e["error"], F.lit("")))), "|").alias("errors"))
    jobs = journal.where(F.col(job).isNotNull()).select(job).distinct()
    out = jobs.join(heads, job, "left").join(states, job, "left").join(done, job, "left").join(failed, job, "left").join(shown, job, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select(
        job, "book_name", F.when(F.col("total").isNull(), "broken").otherwise(F.coalesce("state", F.lit("unknown"))).alias("state"), n("total").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), F.greatest(F.lit(0), n("total") - n("completed")).alias("missing"), F.coalesce("errors", F.lit("")).alias("errors")
    )


def missing(journal: DataFrame, job: str = "job_id", order: str = "rec_id") -> DataFrame:
    """JN-03, SET-06: the chapters of the manifests that no chapter record completes."""
    wanted = manifests(journal, job, order, ("chapters",)).select(job, F.explode("chapters").alias("c")).select(job, F.col("c.index").alias("index"), F.col("c.title").alias("title"), F.col("c.url").alias("url"))
    return wanted.join(chapters(journal, job, order, ()).select(job, "index"), [job, "index"], "left_anti")


def assembled(journal: DataFrame, job: str = "job_id", order: str = "rec_id") -> DataFrame:
    """SNK-04: (job, position, piece): the text of each complete job in order, a header first.

    A job that lacks a chapter is not assembled. The pieces are rows, so that a long book is never one
    value; ``sinks.write_text`` writes them in order.
    """
    lacking = missing(journal, job, order).select(job).distinct()
    heads = manifests(journal, job, order, ("book_name", "chapters")).where(F.size("chapters") > 0).join(lacking, job, "left_anti")
    header = heads.select(job, F.lit(-1).alias("position"), F.concat(F.coalesce("book_name", F.lit("")), F.lit("\n"), F.size("chapters").cast("string"), F.lit("\n\n")).alias("piece"))
    wanted = heads.select(job, F.posexplode("chapters").alias("position", "c")).select(job, "position", F.col("c.index").alias("index"), F.col("c.title").alias("_title"))
    text = chapters(journal, job, order, ("title", "content"))
    body = wanted.join(text, [job, "index"]).select(job, "position", F.concat(F.coalesce("title", "_title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n")).alias("piece"))
    return header.unionByName(body)


def reserved(journal: DataFrame, job: str = "job_id", order: str = "rec_id") -> DataFrame:
    """SNK-05, JN-09: the jobs whose output name an earlier job's manifest has reserved."""
    heads = journal.where((F.col("kind") == "manifest") & (X.trim(F.coalesce("output_filename", F.lit(""))) != "")).groupBy(job, "output_filename").agg(F.min(order).alias(order))
    first = heads.groupBy("output_filename").agg(F.min_by(job, order).alias("reserved_by"))
    return heads.join(first, "output_filename").where(F.col(job) != F.col("reserved_by")).select(job, "output_filename", "reserved_by")


def streaks(outcomes: DataFrame, group: str, order: list[str], error: str) -> DataFrame:
    """WIN-04, WIN-05: for each outcome how many failures in a row, and in a row with the same error, end at it.

    error: null for a success.
    """
    w = Window.partitionBy(group).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col(error).isNotNull()
    df = outcomes.withColumn("_island", F.sum(F.when(bad, 0).otherwise(1)).over(upto))
    changed = ~F.lag(error).over(w).eqNullSafe(F.col(error))
    df = df.withColumn("_same", F.sum(F.when(changed, 1).otherwise(0)).over(upto))
    inside = lambda c: F.when(bad, F.sum(F.when(bad, 1).otherwise(0)).over(Window.partitionBy(group, c).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).otherwise(0)
    return df.withColumns({"failures_in_row": inside("_island").cast("bigint"), "same_error_in_row": inside("_same").cast("bigint")}).drop("_island", "_same")


def stop_points(outcomes: DataFrame, group: str, order: list[str], error: str, same: int = 3, any_: int = 6) -> DataFrame:
    """WIN-06: where each group would stop: at max(2, same) equal errors or max(that, any) failures in a row."""
    least = max(2, same)
    hit = streaks(outcomes, group, order, error).where((F.col("same_error_in_row") >= least) | (F.col("failures_in_row") >= max(least, any_)))
    w = Window.partitionBy(group).orderBy(*order)
    return hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resumed(journal: DataFrame, store: DataFrame, job: str = "job_id", order: str = "rec_id", least_chars: int = 1) -> DataFrame:
    """STM-04: the records that going on with every job appends to its journal, in their order (job, step, ...).

    store: (url, title, content), one row for each address that can be fetched. A job with missing chapters is
    "downloading"; each missing chapter gives a chapter or an error record; then the job is "downloaded", or
    "failed" with the number of errors. Jobs that lack nothing are "assembled". What is appended makes
    these records part of the journal, so going on once more starts where this ended.
    """
    lacking = missing(journal, job, order)
    got = lacking.join(store.select("url", F.col("title").alias("_title"), F.col("content").alias("_content"), F.lit(True).alias("_there")), "url", "left")
    full = F.coalesce(F.length(X.trim(F.col("_content"))), F.lit(0)) >= least_chars
    none = lambda kind: F.lit(None).cast(kind)
    units = got.select(
        job, F.lit(1).alias("step"), F.when(full, "chapter").otherwise("error").alias("kind"), "index", F.coalesce(X.blank_to_null(F.col("_title")), "title").alias("title"), "url", F.when(full, F.col("_content")).alias("content"),
        F.when(~full, F.when(F.col("_there").isNull(), "page not found").otherwise("chapter content empty")).alias("error"), none("string").alias("state"), none("int").alias("missing_count"), none("int").alias("error_count"),
    )
    counts = units.groupBy(job).agg(F.count("*").cast("int").alias("missing_count"), F.count("error").cast("int").alias("error_count"))
    heads = manifests(journal, job, order, ("chapters",)).where(F.size("chapters") > 0).select(job).join(counts, job, "left")
    bad = F.coalesce("error_count", F.lit(0)) > 0
    begun = heads.where("missing_count is not null").select(job, F.lit(0).alias("step"), F.lit("downloading").alias("state"), "missing_count", none("int").alias("error_count"))
    ended = heads.select(job, F.lit(2).alias("step"), F.when(F.col("missing_count").isNull(), "assembled").when(bad, "failed").otherwise("downloaded").alias("state"), none("int").alias("missing_count"), F.when(bad, F.col("error_count")).alias("error_count"))
    states = begun.unionByName(ended).withColumn("kind", F.lit("state"))
    return units.unionByName(states, allowMissingColumns=True)


def without_finished(journal: DataFrame, job: str = "job_id", order: str = "rec_id", state: str = "assembled") -> DataFrame:
    """SNK-09: the journal without the jobs whose last state is that their text has been written."""
    last = journal.where(F.col("kind") == "state").groupBy(job).agg(F.max_by("state", order).alias("_state")).where(F.col("_state") == state)
    return journal.join(last.select(job), job, "left_anti")


def waves(units: DataFrame, group: str, order: list[str], window: int) -> DataFrame:
    """STM-05: in which wave each unit is sent out when at most ``window`` of a group run at once."""
    return units.withColumn("wave", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / F.lit(window)).cast("int"))

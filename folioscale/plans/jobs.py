"""Queries over the journals of jobs and the health of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health, journal, ranking
from ..session import scratch, table
from ..streaming import health as stream


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job")


def journal_replay(spark: SparkSession, folder: str) -> DataFrame:
    return journal.chapters(_jobs(spark, folder)).select("job_id", "index", "rec_id", "title", "url")


def journal_errors(spark: SparkSession, folder: str) -> DataFrame:
    return journal.open_errors(_jobs(spark, folder)).select("job_id", "index", "rec_id", "error", "attempt")


def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return journal.status(_jobs(spark, folder))


def missing_chapters(spark: SparkSession, folder: str) -> DataFrame:
    return journal.missing(_jobs(spark, folder))


def assemble_text(spark: SparkSession, folder: str) -> DataFrame:
    return journal.assembled(_jobs(spark, folder)).select("job_id", "position", "piece")


def output_reserved(spark: SparkSession, folder: str) -> DataFrame:
    return journal.reserved(_jobs(spark, folder))


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _jobs(spark, folder).where("kind in ('chapter', 'error')").select("job_id", "rec_id", F.when(F.col("kind") == "error", F.coalesce("error", F.lit("?"))).alias("error"))


def failure_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return journal.streaks(_outcomes(spark, folder), "job_id", ["rec_id"], "error").drop("error")


def stop_points(spark: SparkSession, folder: str) -> DataFrame:
    return journal.stop_points(_outcomes(spark, folder), "job_id", ["rec_id"], "error", 2, 3).select("job_id", "rec_id")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Every chapter and error record as an outcome of its source: how long it took to be delivered; and a mark for each source that gives no downloads."""
    rows = _jobs(spark, folder).where("kind in ('chapter', 'error') and source_id is not null and saved_at is not null")
    stage = F.when(F.col("index") == 0, "preflight").otherwise("download")
    ms = F.round((F.unix_micros("delivered_at") / 1e6 - F.col("saved_at")) * 1000)
    none = F.lit(None).cast("string")
    outcomes = rows.select("source_id", stage.alias("stage"), F.col("saved_at").alias("at"), F.col("rec_id").alias("id"), (F.col("kind") == "chapter").alias("ok"), ms.alias("elapsed_ms"), "error", F.when(F.col("kind") == "chapter", F.col("title")).alias("note"), none.alias("mark"), F.create_map(F.lit("batch"), "batch_id", F.lit("kind"), "kind").alias("metadata"))
    marks = table(spark, folder, "book_source").where("not supports_download").select("source_id", F.lit("preflight").alias("stage"), F.coalesce("updated_at", F.lit(0.0)).alias("at"), F.lit(-1).cast("bigint").alias("id"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("double").alias("elapsed_ms"), none.alias("error"), F.array_join("issues", "；").alias("note"), F.lit("unsupported").alias("mark"))
    return outcomes.unionByName(marks, allowMissingColumns=True)


def _tried(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).where("mark is null")


def source_stats(spark: SparkSession, folder: str) -> DataFrame:
    return health.stats(_tried(spark, folder))


def health_fold(spark: SparkSession, folder: str) -> DataFrame:
    return health.health(events(spark, folder))


def health_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return health.metadata(events(spark, folder))


def health_defaults(spark: SparkSession, folder: str) -> DataFrame:
    return health.with_defaults(table(spark, folder, "book_source").select("source_id"), health.health(events(spark, folder)))


def health_state_counts(spark: SparkSession, folder: str) -> DataFrame:
    return health.state_counts(health_defaults(spark, folder))


def health_by_stage(spark: SparkSession, folder: str) -> DataFrame:
    return health.by_stage(health_defaults(spark, folder))


def stage_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """What is said of every stage of every source."""
    return health_defaults(spark, folder).select("source_id", "stage", ranking.stage_summary(F.col("note"), F.col("last_error"), F.col("state")).alias("summary"))


def rolling_means(spark: SparkSession, folder: str) -> DataFrame:
    return health.rolling_means(_tried(spark, folder))


def _store(spark: SparkSession, folder: str) -> DataFrame:
    """What can be fetched: the last preview of each address."""
    return table(spark, folder, "fetch_preview").where("url is not null").groupBy("url").agg(F.max_by("title", "preview_id").alias("title"), F.max_by("text_preview", "preview_id").alias("content"))


def job_resume(spark: SparkSession, folder: str) -> DataFrame:
    """The records that going on with every job appends, previews being the pages there are."""
    got = journal.resumed(_jobs(spark, folder), _store(spark, folder))
    return got.withColumn("content", F.sha1("content")).na.fill(-1, ["index", "missing_count", "error_count"])


def journal_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """The records of jobs that are not completed."""
    return journal.without_finished(_jobs(spark, folder), state="completed").groupBy("job_id").agg(F.count("*").alias("records"))


def dispatch_waves(spark: SparkSession, folder: str) -> DataFrame:
    return journal.waves(journal.missing(_jobs(spark, folder)), "job_id", ["index"], 3).select("job_id", "index", "wave")


def error_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _jobs(spark, folder).where("kind = 'error'")
    return rows.select("rec_id", health.error_class(F.col("error"), F.lit("ValueError")).alias("class"), health.is_timeout(F.col("error")).alias("timeout"), health.retryable(F.col("error")).alias("retry"))


def health_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same fold as a stream over the journal's file; the last row of every key."""
    out, mark = scratch(spark, "stream-out"), scratch(spark, "stream-mark")
    source = scratch(spark, "stream-in")
    events(spark, folder).drop("metadata").write.parquet(source)
    read = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 64).parquet(source)

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

    stream.health_stream(read).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.OUT + ", batch int").parquet(out)
    cols = ["state", "attempts", "successes", "failures", "timeouts", "avg_ms", "last_error", "note"]
    return rows.groupBy("source_id", "stage").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("source_id", "stage", "r.*")


QUERIES = {
    f.__name__: f
    for f in (journal_replay, journal_errors, job_status, missing_chapters, assemble_text, output_reserved, failure_streaks, stop_points, source_stats, health_fold, health_metadata, health_defaults, health_state_counts, health_by_stage, rolling_means, error_classes, health_stream, stage_summaries, job_resume, journal_cleanup, dispatch_waves)
}

_LAST = """SELECT job_id, index, max(rec_id) AS rec_id, arg_max_null(title, rec_id) AS title, arg_max_null(url, rec_id) AS url FROM job WHERE kind = 'chapter' AND index IS NOT NULL GROUP BY job_id, index"""
_ERRORS = """SELECT job_id, index, rec_id, error, attempt FROM (SELECT job_id, index, rec_id, error, attempt, kind, max(CASE WHEN kind = 'chapter' THEN rec_id END) OVER (PARTITION BY job_id, index) AS done,
 row_number() OVER (PARTITION BY job_id, index, kind ORDER BY rec_id DESC) AS n FROM job WHERE kind IN ('chapter', 'error') AND index IS NOT NULL) WHERE kind = 'error' AND n = 1 AND (done IS NULL OR done < rec_id)"""
_HEADS = "SELECT job_id, arg_min_null(book_name, rec_id) AS book_name, arg_min_null(output_filename, rec_id) AS output_filename, arg_min_null(chapters, rec_id) AS chapters FROM job WHERE kind = 'manifest' GROUP BY job_id"
_WANTED = f"SELECT job_id, book_name, (n - 1)::INT AS position, c.index AS index, c.title AS title, c.url AS url FROM (SELECT *, unnest(chapters) AS c, generate_subscripts(chapters, 1) AS n FROM ({_HEADS}))"
_MISSING = f"SELECT job_id, index, title, url FROM ({_WANTED}) w WHERE NOT EXISTS (SELECT 1 FROM ({_LAST}) l WHERE l.job_id = w.job_id AND l.index = w.index)"
_OUTCOMES = "SELECT job_id, rec_id, CASE WHEN kind = 'error' THEN coalesce(error, '?') END AS error FROM job WHERE kind IN ('chapter', 'error')"
_STREAKS = f"""SELECT *, CASE WHEN error IS NULL THEN 0 ELSE count(error) OVER (PARTITION BY job_id, island ORDER BY rec_id) END AS failures_in_row, CASE WHEN error IS NULL THEN 0 ELSE count(error) OVER (PARTITION BY job_id, same ORDER BY rec_id) END AS same_error_in_row
FROM (SELECT job_id, rec_id, error, sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) OVER w AS island, sum(CASE WHEN error IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER w AS same FROM (SELECT *, lag(error) OVER (PARTITION BY job_id ORDER BY rec_id) AS prev FROM ({_OUTCOMES})) WINDOW w AS (PARTITION BY job_id ORDER BY rec_id))"""
_EVENTS = """SELECT source_id, CASE WHEN index = 0 THEN 'preflight' ELSE 'download' END AS stage, saved_at AS ts, rec_id AS id, kind = 'chapter' AS ok, greatest(0, round((epoch_us(delivered_at) / 1e6 - saved_at) * 1000)) AS ms, error, CASE WHEN kind = 'chapter' THEN title END AS note, NULL::VARCHAR AS mark, batch_id, kind FROM job WHERE kind IN ('chapter', 'error') AND source_id IS NOT NULL AND saved_at IS NOT NULL
UNION ALL SELECT source_id, 'preflight', coalesce(updated_at, 0), -1, NULL, NULL, NULL, array_to_string(issues, '；'), 'unsupported', NULL, NULL FROM book_source WHERE NOT supports_download"""
_TIMEOUT = "coalesce(regexp_matches(error, '(?i)timeout|timed out|超时'), false)"
_HEALTH = f"""SELECT source_id, stage, CASE WHEN m IS NOT NULL THEN m WHEN good THEN 'healthy' WHEN successes > 0 AND failures <= successes THEN 'degraded' ELSE 'broken' END AS state, attempts, successes, failures, timeouts, avg_ms, last_success_at, last_failure_at,
 CASE WHEN m IS NULL AND NOT good THEN err END AS last_error, CASE WHEN m IS NOT NULL OR good THEN coalesce(n, '') ELSE '' END AS note
FROM (SELECT source_id, stage, count(*) FILTER (WHERE mark IS NULL) AS attempts, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures, count(*) FILTER (WHERE NOT ok AND {_TIMEOUT}) AS timeouts, coalesce(round_even(avg(ms), 3), 0) AS avg_ms,
 max(CASE WHEN ok THEN ts END) AS last_success_at, max(CASE WHEN NOT ok THEN ts END) AS last_failure_at, last(coalesce(ok, false) ORDER BY ts, id) AS good, last(error ORDER BY ts, id) AS err, last(note ORDER BY ts, id) AS n, last(mark ORDER BY ts, id) AS m FROM ({_EVENTS}) GROUP BY source_id, stage)"""
_DEFAULTS = f"SELECT s.source_id, g.stage, coalesce(h.state, 'unknown') AS state, coalesce(attempts, 0)::BIGINT AS attempts, coalesce(successes, 0)::BIGINT AS successes, coalesce(failures, 0)::BIGINT AS failures, coalesce(timeouts, 0)::BIGINT AS timeouts, coalesce(avg_ms, 0) AS avg_ms, last_success_at, last_failure_at, last_error, coalesce(note, '') AS note FROM book_source s CROSS JOIN (SELECT unnest(['search', 'preflight', 'download']) AS stage) g LEFT JOIN ({_HEALTH}) h ON h.source_id = s.source_id AND h.stage = g.stage"
BY_STAGE = f"SELECT source_id, max(CASE WHEN stage = 'search' THEN state END) AS search, max(CASE WHEN stage = 'preflight' THEN state END) AS preflight, max(CASE WHEN stage = 'download' THEN state END) AS download FROM ({_DEFAULTS}) GROUP BY source_id"
_NOT_BLANK = r"regexp_matches(coalesce({}, ''), '[^\s\x{{0B}}\x{{85}}\p{{Z}}]')"
_RESUMED = f"""SELECT * REPLACE (coalesce(index, -1) AS index, coalesce(missing_count, -1) AS missing_count, coalesce(error_count, -1) AS error_count) FROM (WITH m AS (SELECT m.*, s.url IS NOT NULL AS there, s.title AS st, s.content AS sc, s.content IS NOT NULL AND {_NOT_BLANK.format('s.content')} AS ok FROM ({_MISSING}) m
 LEFT JOIN (SELECT url, arg_max_null(title, preview_id) AS title, arg_max_null(text_preview, preview_id) AS content FROM fetch_preview WHERE url IS NOT NULL GROUP BY url) s USING (url)),
j AS (SELECT h.job_id, c.n, c.e FROM ({_HEADS}) h LEFT JOIN (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS e FROM m GROUP BY job_id) c USING (job_id) WHERE len(h.chapters) > 0)
SELECT job_id, 1 AS step, CASE WHEN ok THEN 'chapter' ELSE 'error' END AS kind, index, CASE WHEN {_NOT_BLANK.format('st')} THEN st ELSE title END AS title, url, CASE WHEN ok THEN sha1(sc) END AS content, CASE WHEN NOT there THEN 'page not found' WHEN NOT ok THEN 'chapter content empty' END AS error, NULL::VARCHAR AS state, NULL::INT AS missing_count, NULL::INT AS error_count FROM m
UNION ALL SELECT job_id, 0, 'state', NULL, NULL, NULL, NULL, NULL, 'downloading', n::INT, NULL FROM j WHERE n IS NOT NULL
UNION ALL SELECT job_id, 2, 'state', NULL, NULL, NULL, NULL, NULL, CASE WHEN n IS NULL THEN 'assembled' WHEN e > 0 THEN 'failed' ELSE 'downloaded' END, NULL, CASE WHEN e > 0 THEN e::INT END FROM j)"""

SQL = {
    "journal_replay": _LAST,
    "journal_errors": _ERRORS,
    "job_status": f"""
SELECT j.job_id, h.book_name, CASE WHEN h.job_id IS NULL THEN 'broken' ELSE coalesce(s.state, 'unknown') END AS state, coalesce(len(h.chapters), 0)::BIGINT AS total, coalesce(d.n, 0)::BIGINT AS completed, coalesce(e.n, 0)::BIGINT AS failed, greatest(0, coalesce(len(h.chapters), 0) - coalesce(d.n, 0))::BIGINT AS missing, coalesce(t.errors, '') AS errors
FROM (SELECT DISTINCT job_id FROM job WHERE job_id IS NOT NULL) j LEFT JOIN ({_HEADS}) h USING (job_id)
LEFT JOIN (SELECT job_id, arg_max_null(state, rec_id) AS state FROM job WHERE kind = 'state' GROUP BY job_id) s USING (job_id)
LEFT JOIN (SELECT job_id, count(*) AS n FROM ({_LAST}) GROUP BY job_id) d USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS n FROM ({_ERRORS}) GROUP BY job_id) e USING (job_id)
LEFT JOIN (SELECT job_id, string_agg(index || ':' || coalesce(error, ''), '|' ORDER BY index) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY index) AS k FROM ({_ERRORS})) WHERE k <= 10 GROUP BY job_id) t USING (job_id)""",
    "missing_chapters": _MISSING,
    "assemble_text": f"""
WITH ok AS (SELECT * FROM ({_HEADS}) WHERE len(chapters) > 0 AND job_id NOT IN (SELECT job_id FROM ({_MISSING}))),
l AS (SELECT job_id, index, arg_max_null(title, rec_id) AS title, arg_max_null(content, rec_id) AS content, arg_max_null(struct_pack(t := title, c := content), rec_id) AS r FROM job WHERE kind = 'chapter' AND index IS NOT NULL GROUP BY job_id, index)
SELECT job_id, -1 AS position, coalesce(book_name, '') || chr(10) || len(chapters) || chr(10) || chr(10) AS piece FROM ok
UNION ALL SELECT w.job_id, w.position, coalesce(l.r.t, w.title, '') || chr(10) || chr(10) || coalesce(l.r.c, '') || chr(10) || chr(10) FROM ({_WANTED}) w JOIN ok USING (job_id) JOIN l ON l.job_id = w.job_id AND l.index = w.index""",
    "output_reserved": "WITH h AS (SELECT job_id, output_filename, min(rec_id) AS rec_id FROM job WHERE kind = 'manifest' AND trim(coalesce(output_filename, '')) <> '' GROUP BY ALL), f AS (SELECT output_filename, arg_min_null(job_id, rec_id) AS reserved_by FROM h GROUP BY output_filename) SELECT h.job_id, h.output_filename, f.reserved_by FROM h JOIN f USING (output_filename) WHERE h.job_id <> f.reserved_by",
    "failure_streaks": f"SELECT job_id, rec_id, failures_in_row, same_error_in_row FROM ({_STREAKS})",
    "stop_points": f"SELECT job_id, min(rec_id) AS rec_id FROM ({_STREAKS}) WHERE same_error_in_row >= 2 OR failures_in_row >= 3 GROUP BY job_id",
    "source_stats": f"SELECT source_id, count(*) AS attempts, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures, count(*) FILTER (WHERE NOT ok AND {_TIMEOUT}) AS timeouts, round_even(avg(ms), 3) AS avg_duration_ms, coalesce(round_even(avg(CASE WHEN ok THEN ms END), 3), 0) AS avg_success_ms, max(CASE WHEN ok THEN ts END) AS last_success_at, max(CASE WHEN NOT ok THEN ts END) AS last_failure_at FROM ({_EVENTS}) WHERE mark IS NULL GROUP BY source_id",
    "health_fold": _HEALTH,
    "health_metadata": f"SELECT source_id, stage, k AS key, v AS value FROM (SELECT source_id, stage, last(batch_id ORDER BY ts, id) AS a, last(kind ORDER BY ts, id) AS b FROM ({_EVENTS}) WHERE mark IS NULL GROUP BY source_id, stage), LATERAL (SELECT 'batch' AS k, a AS v UNION ALL SELECT 'kind', b)",
    "health_defaults": _DEFAULTS,
    "health_state_counts": f"SELECT stage, state, count(*) AS n FROM ({_DEFAULTS}) GROUP BY ALL",
    "health_by_stage": BY_STAGE,
    "stage_summaries": f"SELECT source_id, stage, CASE WHEN trim(note) <> '' THEN trim(note) WHEN trim(coalesce(last_error, '')) <> '' THEN trim(last_error) ELSE CASE state WHEN 'healthy' THEN '最近探测成功' WHEN 'degraded' THEN '最近探测不稳定' WHEN 'broken' THEN '最近探测失败' WHEN 'unsupported' THEN '静态或运行时规则不支持' ELSE '尚无健康记录' END END AS summary FROM ({_DEFAULTS})",
    "job_resume": _RESUMED,
    "journal_cleanup": "SELECT job_id, count(*) AS records FROM job j WHERE job_id IS NULL OR job_id NOT IN (SELECT job_id FROM (SELECT job_id, arg_max_null(state, rec_id) AS s FROM job WHERE kind = 'state' AND job_id IS NOT NULL GROUP BY job_id) WHERE s = 'completed') GROUP BY job_id",
    "dispatch_waves": f"SELECT job_id, index, ((row_number() OVER (PARTITION BY job_id ORDER BY index) - 1) // 3)::INT AS wave FROM ({_MISSING})",
    "rolling_means": f"""
WITH RECURSIVE e AS (SELECT source_id, ms, row_number() OVER (PARTITION BY source_id ORDER BY ts, id) AS n FROM ({_EVENTS}) WHERE mark IS NULL),
r AS (SELECT source_id, n, format('{{:.3f}}', ms)::DOUBLE AS mean FROM e WHERE n = 1 UNION ALL SELECT e.source_id, e.n, format('{{:.3f}}', (r.mean * (e.n - 1) + e.ms) / e.n)::DOUBLE FROM r JOIN e ON e.source_id = r.source_id AND e.n = r.n + 1)
SELECT source_id, max(n)::BIGINT AS n, arg_max(mean, n) AS mean FROM r GROUP BY source_id""",
    "error_classes": r"""SELECT rec_id, CASE WHEN error IS NULL THEN NULL WHEN contains(lower(error), 'timeout') OR contains(lower(error), 'timed out') OR contains(error, '超时') THEN 'timeout' WHEN contains(lower(error), 'network') OR contains(error, '网络') THEN 'network' WHEN contains(error, '目录') OR contains(lower(error), 'ruletoc') THEN 'preflight_rule_toc' WHEN contains(lower(error), 'http ') THEN 'http' ELSE 'valueerror' END AS class,
 coalesce(regexp_matches(error, '(?i)timeout|timed out|超时'), false) AS timeout, coalesce(regexp_matches(error, '\b(408|425|429|500|502|503|504)\b|(?i:reset|refused|temporar|unreachable|timed out|timeout)'), false) AS retry FROM job WHERE kind = 'error'""",
    "health_stream": f"SELECT * EXCLUDE (last_success_at, last_failure_at) FROM ({_HEALTH})",
}

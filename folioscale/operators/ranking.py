"""Federated search results: match classes, ranks, limits and candidates
(SRT-01 to SRT-05, LIM-01, LIM-02, LIM-06, SET-01, SET-02, SET-05, JN-01, JN-02, CLS-07, CLS-08, AGG-13, FLT-02, FLT-03, FLT-12, STR-24)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Ranks of enumerated values, in order. Fixed values.
TITLE_RANKS = ["exact", "contains", "other"]
AUTHOR_RANKS = ["exact", "contains", "unspecified", "missing", "mismatch"]
STATE_RANKS = ["healthy", "degraded", "unknown", "broken", "unsupported"]
#: What a stage's state is called where nothing else is noted. Fixed values.
STATE_LABELS = {"healthy": "最近探测成功", "degraded": "最近探测不稳定", "broken": "最近探测失败", "unsupported": "静态或运行时规则不支持"}
UNSUPPORTED_CANDIDATE = "静态规则不支持"
NO_RECORD = "尚无健康记录"
#: Why a source or a hit is passed over. Fixed values.
NO_SEARCH, NO_ADDRESS, NO_DOWNLOAD = "当前书源不支持 route A 搜索", "搜索结果缺少 book_url，无法自动下载", "书源当前不支持 TXT 下载"


def rank_of(c: Column, order: Sequence[str]) -> Column:
    """CLS-08: the place of a value in a fixed order, behind all for any other."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), c).cast("int"), F.lit(0)) + F.when(c.isin(list(order)), 0).otherwise(len(order) + 1) - 1


def state_rank(state: Column) -> Column:
    """CLS-08: healthy first; no state counts as unknown."""
    return rank_of(F.coalesce(state, F.lit("unknown")), STATE_RANKS)


def extractor_rank(c: Column, other: int = 3, script: int = 4) -> Column:
    """CLS-08: extractors of a template first, then the rules, none, any other, scripts last."""
    name = X.trim(F.coalesce(c, F.lit("")))
    return F.when(name.startswith("template_"), 0).when(name == "fallback_rule", 1).when(name == "", 2).when(F.contains(name, F.lit("javascript")), script).otherwise(other)


def profile_rank(c: Column) -> Column:
    """SRT-02: the rank of a source's first extractor; a source without a profile (null) ranks like the rules."""
    return F.when(c.isNull(), 1).otherwise(extractor_rank(c, other=2, script=3))


def hit_order(title: Column, author: Column, keyword: Column, downloadable: Column) -> list[Column]:
    """SRT-01: exact before contained before other, downloadable first, then title and author."""
    return [rank_of(X.title_match(title, keyword), TITLE_RANKS), F.when(downloadable, 0).otherwise(1), F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(author, F.lit("")))]


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group (LIM-01, WIN-02, SET-02); partial limits run before the exchange."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """All rows numbered from 1 in an ascending order of values over the whole table, without gathering them in one task.

    The rows are range-partitioned and sorted by the order; a partition's rows are numbered from the
    count of those before it. Only a row per partition reaches the driver.
    """
    keys = {f"_k{n}": c for n, c in enumerate(order)}
    ranged = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    numbered = ranged.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    counts = sorted((r["_part"], r["n"], r["low"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("low")).collect())
    shifts, seen = [], 0
    for part, n, low in counts:
        shifts.append((part, seen + 1 - low))
        seen += n
    shift = df.sparkSession.createDataFrame(shifts, "_part int, _shift bigint")
    return numbered.join(F.broadcast(shift), "_part").withColumn(name, (F.col("_id") + F.col("_shift")).cast("bigint")).drop("_part", "_id", "_shift")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """SET-01: the hits of all sources; a column that a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def priority_order(state: Column, downloadable: Column, stats: dict[str, Column], extractor: Column | None = None) -> list[Column]:
    """SRT-02: the seven keys by which sources are asked: state, download, profile, history, penalty, speed, recency.

    stats: attempts (null where the source has no entry at all), successes, failures, timeouts,
    avg_duration_ms, avg_success_ms, last_success_at, last_failure_at. A mean of 0 or null is none: without
    a mean of successes the mean of all attempts counts, without that one infinity.
    """
    n = {k: F.greatest(F.lit(0), F.coalesce(stats[k], F.lit(0))) for k in ("successes", "failures", "timeouts")}
    mean = lambda c, other: F.when(F.coalesce(c, F.lit(0.0)) != 0, c.cast("double")).otherwise(other)
    duration = mean(stats["avg_duration_ms"], F.lit(float("inf")))
    history = F.when(stats["attempts"].isNull(), 1).when(n["successes"] > 0, 0).otherwise(2)
    penalty = F.when(history == 0, n["timeouts"] * 2 + F.greatest(F.lit(0), n["failures"] - n["successes"])).when(history == 1, 0).otherwise(n["timeouts"] * 2 + n["failures"])
    speed = F.when(history == 0, mean(stats["avg_success_ms"], duration)).when(history == 1, float("inf")).otherwise(duration)
    recency = F.when(history == 0, -F.coalesce(stats["last_success_at"], F.lit(0.0))).when(history == 1, 0.0).otherwise(F.coalesce(stats["last_failure_at"], F.lit(0.0)))
    profile = F.lit(1) if extractor is None else profile_rank(extractor)
    return [state_rank(state), F.when(F.coalesce(downloadable, F.lit(False)), 0).otherwise(1), profile, history, penalty.cast("bigint"), speed.cast("double"), recency.cast("double")]


def runtime_state(stats: dict[str, Column]) -> Column:
    """AGG-04 in one look: healthy, degraded, broken or unknown from the counters."""
    s, f = F.coalesce(stats["successes"], F.lit(0)), F.coalesce(stats["failures"], F.lit(0))
    return F.when(s + f == 0, "unknown").when(f == 0, "healthy").when((s > 0) & (f <= s), "degraded").otherwise("broken")


def stage_summary(note: Column, error: Column, state: Column, unsupported: str = STATE_LABELS["unsupported"]) -> Column:
    """STR-24: the note, or else the last error, or else what the state is called."""
    labels = STATE_LABELS | {"unsupported": unsupported}
    label = reduce(lambda acc, x: acc.when(state == x[0], x[1]), labels.items(), F.when(state.isNull(), NO_RECORD)).otherwise(NO_RECORD)
    text = lambda c: X.blank_to_null(X.trim(c.cast("string")))
    return F.coalesce(text(note), text(error), label)


def search_skip_reason(supported: Column, issues: Column, state: Column, summary: Column) -> Column:
    """FLT-02: why a source is not searched: its issues, or the summary of a stage that is unsupported by now; null where it is."""
    listed = F.array_join(F.coalesce(issues, F.array().cast("array<string>")), "；")
    return F.when(~F.coalesce(supported, F.lit(False)), F.when(listed != "", listed).otherwise(NO_SEARCH)).when(state == "unsupported", summary)


def downloadable(supported: Column, preflight: Column, download: Column) -> Column:
    """FLT-03: supported by its definition, and no stage found unsupported since."""
    unsupported = lambda c: F.coalesce(c == "unsupported", F.lit(False))
    return F.coalesce(supported, F.lit(False)) & ~unsupported(preflight) & ~unsupported(download)


def skip_reason(url: Column, able: Column, issues: Column, notes: Sequence[tuple[Column, Column]] = ()) -> Column:
    """CLS-07: why a candidate cannot be taken; null where it can.

    notes: (state, summary) of the stages, of which the first unsupported one is the reason.
    """
    listed = F.array_join(issues, "；")
    reason = reduce(lambda acc, x: F.when(x[0] == "unsupported", x[1]).otherwise(acc), reversed(list(notes)), F.when(listed != "", listed).otherwise(NO_DOWNLOAD))
    return F.when(X.trim(F.coalesce(url, F.lit(""))) == "", NO_ADDRESS).when(~F.coalesce(able, F.lit(False)), reason)


def identity_mismatch(title: Column, author: Column, expected_title: Column, expected_author: Column) -> Column:
    """FLT-12: which of title and author is not the expected one; null where both fit. Nothing expected fits anything."""
    same = lambda a, b: X.compare_key(a) == X.compare_key(b)
    expected = lambda c: X.compare_key(c) != ""
    return F.when(expected(expected_title) & ~same(title, expected_title), "title").when(expected(expected_author) & ~same(author, expected_author), "author")


def checked_identity(df: DataFrame, title: str, author: str, expected_title: Column, expected_author: Column) -> DataFrame:
    """FLT-12 as an error: a row that is another book than expected fails the query."""
    wrong = identity_mismatch(F.col(title), F.col(author), expected_title, expected_author)
    message = F.concat(wrong, F.lit(" mismatch: expected "), F.when(wrong == "title", expected_title).otherwise(expected_author), F.lit(", got "), F.coalesce(F.when(wrong == "title", F.col(title)).otherwise(F.col(author)), F.lit("nothing")))
    return df.withColumn(title, F.when(wrong.isNotNull(), F.raise_error(message)).otherwise(F.col(title)))


def candidates(hits: DataFrame, sources: DataFrame, health: DataFrame, keyword: str = "match_keyword", author: Column | None = None, id: str = "hit_id") -> DataFrame:
    """Hits joined with what is known of their sources, classified, one for each (source, address, title,
    author), with a skip reason and their place by ten keys within their keyword (SRT-03).

    sources: (source_id, name, supports_download, issues, extractor); health: (source_id, search, preflight,
    download) with the stages' states, null where nothing is known, and perhaps preflight_note and
    download_note. Both hold a row per source; Spark
    broadcasts them if they are small. At most three issues of a source count.
    """
    author = F.lit(None).cast("string") if author is None else author
    none = F.array().cast("array<string>")
    known = sources.select("source_id", F.col("supports_download").alias("_able"), F.slice(F.coalesce("issues", none), 1, 3).alias("_issues"), F.col("extractor").alias("_extractor"), F.col("name").alias("_name"))
    notes = [c for c in ("preflight_note", "download_note") if c in health.columns]
    stages = health.select("source_id", *(F.coalesce(s, F.lit("unknown")).alias(f"{s}_state") for s in ("search", "preflight", "download")), *notes)
    df = hits.join(known, "source_id", "left").join(stages, "source_id", "left").na.fill("unknown", ["search_state", "preflight_state", "download_state"])
    able = downloadable(F.col("_able"), F.col("preflight_state"), F.col("download_state"))
    noted = lambda s: F.col(f"{s}_note") if f"{s}_note" in hits.columns or f"{s}_note" in health.columns else F.lit(None).cast("string")
    summaries = [(F.col(f"{s}_state"), stage_summary(noted(s), F.lit(None), F.col(f"{s}_state"), UNSUPPORTED_CANDIDATE)) for s in ("preflight", "download")]
    df = df.withColumns(
        {
            "title_match": X.title_match(F.col("title"), F.col(keyword)),
            "author_match": X.author_match(F.col("author"), author),
            "skip_reason": skip_reason(F.col("book_url"), able, F.coalesce("_issues", none), summaries),
        }
    )
    order = [
        rank_of(F.col("title_match"), TITLE_RANKS), rank_of(F.col("author_match"), AUTHOR_RANKS), state_rank(F.col("preflight_state")), state_rank(F.col("download_state")), extractor_rank(F.col("_extractor")), state_rank(F.col("search_state")),
        F.coalesce(F.size("_issues"), F.lit(0)), X.compare_key(F.col("title")), X.compare_key(F.col("author")), X.compare_key(F.coalesce(X.blank_to_null(F.col("source_name")), F.col("_name"), F.col("source_id"))), F.col(id),
    ]
    same = [F.coalesce("source_id", F.lit("")).alias("k0"), X.trim(F.coalesce("book_url", F.lit(""))).alias("k1"), X.compare_key(F.col("title")).alias("k2"), X.compare_key(F.col("author")).alias("k3"), F.coalesce(keyword, F.lit("")).alias("k4")]
    keyed = df.select("*", *same)
    once = first_per_group(keyed, ["k0", "k1", "k2", "k3", "k4"], order, 1, "_copy").drop("_copy", "k0", "k1", "k2", "k3", "k4")
    return once.withColumn("position", F.row_number().over(Window.partitionBy(keyword).orderBy(F.col("skip_reason").isNotNull(), *order)))


def early_stop(outcomes: DataFrame, run: str, order: Sequence[str], hits: str, limit: int) -> DataFrame:
    """LIM-06: the outcomes of each run up to the one that brings the exact hits to the limit."""
    w = Window.partitionBy(run).orderBy(*order)
    before = F.coalesce(F.sum(hits).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return outcomes.withColumn("hits_before", before.cast("bigint")).where(F.col("hits_before") < limit)

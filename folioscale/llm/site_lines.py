"""Lines that one source repeats in chapter after chapter (problem 3).

Method: mergeable heavy-hitter summaries, one per source, then exact counts of the candidates in a
second pass, then removal with a broadcast set.

*First pass.* Every partition keeps a Misra-Gries summary for each source over the distinct line
keys of its chapters: at most ``counters`` keys; when there are more, the (counters+1)-th largest
count is taken from all. Summaries are merged by adding counts and cutting again in a tree. What was
taken away in all is a bound on how far any count can be too low, so each line that stands in
more records than that bound survives. If the bound reaches the number of records that a repeated
line must have, the pass is run again with four times the counters: no line can be missed.

*Second pass.* Candidates are counted exactly, over distinct chapters (a repeat or a new attempt of
a chapter counts once).

*Bound of the broadcasts.* A confirmed line takes ``min_share`` of its source's chapters, so a
source has at most (lines per chapter) / ``min_share`` of them; candidates are at most ``counters``
per source, cut to those above the source's threshold less the bound. Candidates and confirmed lines
stay tables; up to ``block_lines`` of them are broadcast, more are laid out by source in the shared
folder, where each worker reads the sets of the sources it meets. No pass is repeated for them.

Two lines are the same if equal without any white space and with each run of 0-9 taken as one.
Lines of white space only do not count. Null content holds no line and its chapter does not count.
A null source or chapter key is a value like any other.
"""

from __future__ import annotations

import re
import zlib
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import open_folder, scratch, ship, written

SPACE_IN_LINE = re.compile(r"[^\S\n]+")
DIGITS = re.compile(r"[0-9]+")
#: A summary is cut when it holds this many times its counters.
SLACK = 4


def line_keys(content: str) -> list[str]:
    """One key for each piece of the content split at LF; blank lines give the empty key."""
    return DIGITS.sub("0", SPACE_IN_LINE.sub("", content)).split("\n")


def cut(counts: dict[str, int], counters: int) -> int:
    """Cut a summary to ``counters`` keys in place; returns what was taken from each count."""
    if len(counts) <= counters:
        return 0
    take = sorted(counts.values(), reverse=True)[counters]
    for k in [k for k, n in counts.items() if n <= take]:
        del counts[k]
    for k in counts:
        counts[k] -= take
    return take


def _summarise(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, dict[str, int]] = defaultdict(dict)
        lost: dict[str | None, int] = defaultdict(int)
        records: dict[str | None, int] = defaultdict(int)
        for b in batches:
            for source, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = held[source]
                records[source] += 1
                for k in set(line_keys(content)):
                    if k:
                        counts[k] = counts.get(k, 0) + 1
                if len(counts) > SLACK * counters:
                    lost[source] += cut(counts, counters)
        for source, counts in held.items():
            lost[source] += cut(counts, counters)
            keys = list(counts)
            yield pa.RecordBatch.from_pydict(
                {"source": [source], "lines": [keys], "counts": [[counts[k] for k in keys]], "lost": [lost[source]]},
                schema=SUMMARY,
            )

    return run


SUMMARY = pa.schema([("source", pa.string()), ("lines", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("lost", pa.int64())])


def _merge(counters: int, keep: bool):
    def run(t: pa.Table) -> pa.Table:
        counts: dict[str, int] = defaultdict(int)
        lost = sum(t.column("lost").to_pylist())
        for chunk in t.to_batches():
            for lines, ns in zip(chunk.column("lines").to_pylist(), chunk.column("counts").to_pylist()):
                for k, n in zip(lines, ns):
                    counts[k] += n
                if len(counts) > SLACK * counters:
                    lost += cut(counts, counters)
        lost += cut(counts, counters)
        keys = list(counts)
        source = t.column("source")[0].as_py()
        cols = {"source": [source], "lines": [keys], "counts": [[counts[k] for k in keys]], "lost": [lost]}
        return pa.Table.from_pydict(cols | ({} if keep else {"part": [0]}), schema=SUMMARY if keep else SUMMARY.append(pa.field("part", pa.int32())))

    return run


def summaries(texts: DataFrame, counters: int) -> DataFrame:
    """(source, lines, counts, lost): a merged summary for each source.

    Partial summaries of a source are merged in two levels, so that none gathers those of all
    partitions at once.
    """
    kind = "source string, lines array<string>, counts array<bigint>, lost bigint"
    parts = texts.mapInArrow(_summarise(counters), kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    return parts.groupBy("source", "part").applyInArrow(_merge(counters, False), kind + ", part int").groupBy("source").applyInArrow(_merge(counters, True), kind)


def candidates(texts: DataFrame, need: DataFrame, counters: int) -> DataFrame:
    """(source, line, id, need): the lines that may stand in ``need`` records of their source, numbered within it.

    texts: (source, content); need: (source, need). If a summary lost too much to be sure, all are made
    again with four times the counters.
    """
    least = need.select(F.col("source").alias("its_source"), "need")
    while True:
        got = written(summaries(texts, counters), "lines")
        both = got.join(least, F.col("source").eqNullSafe(F.col("its_source")))
        if both.where(F.col("lost") >= F.col("need")).isEmpty():
            break
        counters *= 4
    rows = both.select("source", "lost", "need", F.explode(F.arrays_zip("lines", "counts")).alias("x")).where(F.col("x.counts") + F.col("lost") >= F.col("need"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("line"))  # of at most ``counters`` lines
    return written(rows.select("source", F.col("x.lines").alias("line"), "need").withColumn("id", number), "candidates")


_read: OrderedDict[tuple[str, int], dict] = OrderedDict()


class SetsBySource:
    """Lines with a number each, by source, for use in workers. rows: (source, line, id).

    At most ``limit`` lines are broadcast; beyond that they lie in the shared folder in files by the
    source's checksum, and each worker reads the files of the sources it meets and keeps the last ``KEEP``.
    """

    KEEP = 64

    def __init__(self, rows: DataFrame, limit: int):
        spark = rows.sparkSession
        rows = written(rows, "sets")
        total = rows.count()
        self.held, self.uri, self.buckets = None, "", 0
        if total <= limit:
            sets: dict[str | None, dict[str, int]] = defaultdict(dict)
            for r in rows.collect():  # at most ``limit``
                sets[r["source"]][r["line"]] = r["id"]
            self.held = spark.sparkContext.broadcast(dict(sets))
            return
        self.buckets = 16 * -(-total // limit)
        self.uri = scratch(spark, "sets-by-source")
        bucket = F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "utf-8")), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(self.uri)

    def of(self, source: str | None) -> dict[str, int]:
        if self.held is not None:
            return self.held.value.get(source, {})
        where = self.uri, zlib.crc32((source or "").encode()) % self.buckets
        if where not in _read:
            sets: dict[str | None, dict[str, int]] = defaultdict(dict)
            fs, path = open_folder(f"{self.uri}/bucket={where[1]}")
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                t = pq.read_table(path, filesystem=fs, columns=["source", "line", "id"], partitioning=None)
                for s, k, n in zip(*(t.column(c).to_pylist() for c in ("source", "line", "id"))):
                    sets[s][k] = n
            _read[where] = dict(sets)
            if len(_read) > self.KEEP:
                _read.popitem(last=False)
        _read.move_to_end(where)
        return _read[where].get(source, {})


def _occurrences(wanted: SetsBySource):
    """(source, line, job, chapter): which candidate stands in which chapter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources, lines, at = [], [], []
            for i, (source, content) in enumerate(zip(b.column("source").to_pylist(), b.column("content").to_pylist())):
                own = wanted.of(source)
                for n in {own[k] for k in line_keys(content) if k in own} if own else ():
                    sources.append(source)
                    lines.append(n)
                    at.append(i)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(lines, pa.int32()), b.column("job").take(at), b.column("chapter").take(at)], names=["source", "id", "job", "chapter"])

    return run


def _mark(confirmed: SetsBySource):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, numbers = [], []
            for source, row, content in zip(b.column("source").to_pylist(), b.column("row").to_pylist(), b.column("content").to_pylist()):
                own = confirmed.of(source)
                if own:
                    for n, k in enumerate(line_keys(content), 1):
                        if k in own:
                            rows.append(row)
                            numbers.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(numbers, pa.int32())], names=["row", "line_no"])

    return run


def _strip(confirmed: SetsBySource):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for source, content in zip(b.column("source").to_pylist(), b.column("content").to_pylist()):
                own = {} if content is None else confirmed.of(source)
                out.append(content if not own else "\n".join(p for p, k in zip(content.split("\n"), line_keys(content)) if k not in own))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], names=["row", "content"])

    return run


class SiteLines:
    """Finds, marks and removes the repeated lines of each source.

    df: the records; source, job, chapter, content, row: its columns (row a unique BIGINT).
    """

    def __init__(self, df: DataFrame, source: str, job: str, chapter: str, content: str, row: str, min_chapters: int = 5, min_share: float = 0.04, counters: int = 2000, block_lines: int = 200_000):
        ship(df.sparkSession)
        named = {"row": row, "source": source, "job": job, "chapter": chapter, "content": content}
        self.all = df.select(*(F.col(f"`{c}`").cast("string" if n in ("source", "content") else df.schema[c].dataType).alias(n) for n, c in named.items()))
        self.texts = self.all.where(F.col("content").isNotNull())
        self.min_chapters, self.min_share, self.counters, self.block_lines = min_chapters, min_share, counters, block_lines
        self._confirmed: SetsBySource | None = None

    def confirmed(self) -> SetsBySource:
        """The repeated lines' keys by source."""
        if self._confirmed is None:
            chapters = self.texts.groupBy("source", "job", "chapter").count().groupBy("source").agg(F.count("*").alias("n"))
            need = written(chapters.select("source", F.greatest(F.lit(float(self.min_chapters)), self.min_share * F.col("n")).alias("need")), "chapters")
            found = candidates(self.texts.select("source", "content"), need, self.counters)
            kinds = {f.name: f.dataType.simpleString() for f in self.all.schema}
            wanted = SetsBySource(found.select("source", "line", "id"), self.block_lines)
            seen = self.texts.select("source", "job", "chapter", "content").mapInArrow(_occurrences(wanted), f"source string, id int, job {kinds['job']}, chapter {kinds['chapter']}")
            counts = seen.groupBy("source", "id", "job", "chapter").count().groupBy("source", "id").agg(F.count("*").alias("n"))
            counts = counts.select(F.col("source").alias("its_source"), F.col("id").alias("its_id"), "n")
            kept = found.join(counts, (F.col("id") == F.col("its_id")) & F.col("source").eqNullSafe(F.col("its_source"))).where("n >= need")
            self._confirmed = SetsBySource(kept.select("source", "line", "id"), self.block_lines)
        return self._confirmed

    def marked(self) -> DataFrame:
        """(row, line_no): every place of a repeated line; lines count from 1, blank ones too."""
        return self.texts.select("row", "source", "content").mapInArrow(_mark(self.confirmed()), "row bigint, line_no int")

    def removed(self) -> DataFrame:
        """(row, content): each record's content without the repeated lines; null stays null."""
        return self.all.select("row", "source", "content").mapInArrow(_strip(self.confirmed()), "row bigint, content string")

"""Exactly-once admission of messages that were delivered at least once.

An :class:`IdentityIndex` keeps the 128-bit identifiers of everything admitted so far as
immutable *runs*. A run holds, for each bucket of the hash prefix, one sorted array. A batch is
admitted in one job:

1. every input partition drops its own repeats first, so that an identifier holding a third of
   all rows reaches the exchange at most once per partition;
2. the survivors are exchanged by hash prefix, deduplicated there, and looked up in the runs of
   their bucket by binary search;
3. what is new becomes the batch's run; what is not is reported as surplus.

Runs are written under a name fixed by batch and bucket and count only once the manifest names
them, so a task that is repeated after the loss of an executor rewrites the same bytes. When more
than ``max_runs`` have gathered, each bucket's arrays are merged into one.

Nulls: identity columns compare null as equal to null. A null ``order`` value sorts last. Empty
batches admit nothing. Extra columns of the input are ignored.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import get, open_folder, put, scratch, ship

#: Rows that a partition holds at a time for its local deduplication.
LOCAL_ROWS = 400_000
LAST = 2**63 - 1


def identity(*cols: Column) -> list[Column]:
    """Two 64-bit halves of an identifier over the columns; null is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n")) for c in cols]
    text = F.concat_ws("|", *parts)
    return [F.xxhash64(text), F.xxhash64(F.lit("second half"), text)]


def _load(uri: str) -> np.ndarray:
    data = get(uri)
    return np.zeros((0, 2), np.int64) if data is None else np.load(io.BytesIO(data))


def _save(uri: str, ids: np.ndarray) -> None:
    buf = io.BytesIO()
    np.save(buf, ids)
    put(uri, buf.getvalue())


def contains(run: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which (hi, lo) stand in the run, an array sorted by both halves."""
    found = np.zeros(len(hi), bool)
    if not len(run):
        return found
    at, open_ = np.searchsorted(run[:, 0], hi), np.arange(len(hi))
    while len(open_):
        open_ = open_[at[open_] < len(run)]
        open_ = open_[run[at[open_], 0] == hi[open_]]
        found[open_] |= run[at[open_], 1] == lo[open_]
        at[open_] += 1
    return found


def _firsts(hi: np.ndarray, lo: np.ndarray, when: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row order by identifier, time and row number; and which of them open an identifier."""
    by = np.lexsort((row, when, lo, hi))
    h, l = hi[by], lo[by]
    first = np.ones(len(by), bool)
    first[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    return by, first


def _local(buckets: int):
    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        hi, lo, when, row = (t.column(i).to_numpy() for i in range(4))
        by, first = _firsts(hi, lo, when, row)
        hi, lo, when, row = hi[by], lo[by], when[by], row[by]
        bucket = np.where(first, hi.view(np.uint64) >> np.uint64(44), row.view(np.uint64)) % np.uint64(buckets)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(hi), pa.array(lo), pa.array(when), pa.array(row), pa.array(~first)], names=["bucket", "hi", "lo", "at", "row", "dup"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= LOCAL_ROWS:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return run


def _admit(path: str, runs: Sequence[str], new: str):
    def fn(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        dup = t.column("dup").to_numpy(zero_copy_only=False)
        hi, lo, when, row = (t.column(c).to_numpy()[~dup] for c in ("hi", "lo", "at", "row"))
        by, first = _firsts(hi, lo, when, row)
        hi, lo, row = hi[by], lo[by], row[by]
        known = np.zeros(len(hi), bool)
        for r in runs:
            known |= contains(_load(f"{path}/{r}/{bucket}.npy"), hi, lo)
        fresh = first & ~known
        _save(f"{path}/{new}/{bucket}.npy", np.stack([hi[fresh], lo[fresh]], 1))
        rows = np.concatenate([t.column("row").to_numpy()[dup], row])
        surplus = np.concatenate([np.ones(int(dup.sum()), bool), ~fresh])
        return pa.table({"row": rows, "surplus": surplus})

    return fn


def _merge(path: str, runs: Sequence[str], new: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket in b.column(0).to_pylist():
                ids = np.concatenate([_load(f"{path}/{r}/{bucket}.npy") for r in runs])
                _save(f"{path}/{new}/{bucket}.npy", ids[np.lexsort((ids[:, 1], ids[:, 0]))])
            yield b

    return run


class IdentityIndex:
    """Sorted identifier runs under ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64, max_runs: int = 4):
        ship(spark)
        self.spark, self.path, self.buckets, self.max_runs = spark, path or scratch(spark, "identity"), buckets, max_runs
        held = get(f"{self.path}/manifest.json")
        state = json.loads(held) if held else {"runs": [], "next": 0, "buckets": buckets}
        self.runs, self.next, self.buckets = state["runs"], state["next"], state["buckets"]

    def _commit(self) -> None:
        put(f"{self.path}/manifest.json", json.dumps({"runs": self.runs, "next": self.next, "buckets": self.buckets}).encode())

    def admit(self, batch: DataFrame, keys: Sequence[str], order: str, row: str) -> DataFrame:
        """Admit a batch; returns (row, surplus), one row for each row of the batch.

        Of equal identifiers within the batch the first by (``order``, ``row``) is admitted, unless
        an earlier batch holds it. ``order`` is a timestamp, ``row`` a unique BIGINT.
        """
        name = f"run-{self.next:05d}"
        cols = [c.alias(n) for c, n in zip(identity(*(F.col(f"`{k}`") for k in keys)), ("hi", "lo"))]
        narrow = batch.select(*cols, F.coalesce(F.unix_micros(F.col(f"`{order}`").cast("timestamp")), F.lit(LAST)).alias("at"), F.col(f"`{row}`").cast("bigint").alias("row"))
        local = narrow.mapInArrow(_local(self.buckets), "bucket int, hi bigint, lo bigint, at bigint, row bigint, dup boolean")
        out = local.groupBy("bucket").applyInArrow(_admit(self.path, list(self.runs), name), "row bigint, surplus boolean")
        target = f"{self.path}/out/{name}"
        out.write.mode("overwrite").parquet(target)
        self.runs, self.next = [*self.runs, name], self.next + 1
        self._commit()
        if len(self.runs) > self.max_runs:
            self.merge()
        return self.spark.read.schema("row bigint, surplus boolean").parquet(target)

    def merge(self) -> None:
        """Replace all runs by one, bucket by bucket."""
        name, old = f"run-{self.next:05d}", self.runs
        self.spark.range(0, self.buckets, 1, min(self.buckets, 64)).mapInArrow(_merge(self.path, old, name), "id bigint").write.format("noop").mode("overwrite").save()
        self.runs, self.next = [name], self.next + 1
        self._commit()
        for r in old:
            fs, path = open_folder(f"{self.path}/{r}")
            fs.delete_dir(path)


def surplus_copies(messages: DataFrame, keys: Sequence[str], order: str, row: str, batches: int = 6, buckets: int | None = None) -> DataFrame:
    """Every surplus copy (row) of a table, taken in as ``batches`` deliveries in order of time.

    buckets: by default one for every two million messages, so that a bucket's array stays small.
    """
    spark = messages.sparkSession
    at = F.unix_micros(F.col(f"`{order}`").cast("timestamp"))
    seen = messages.select(F.percentile_approx(at, [i / batches for i in range(1, batches)], 1000).alias("cuts"), F.count("*").alias("n")).first()
    edges = [None, *sorted(set(seen["cuts"] or [])), None]
    index, found = IdentityIndex(spark, buckets=buckets or max(32, -(-seen["n"] // 2_000_000))), None
    for low, high in zip(edges, edges[1:]):
        part = messages
        if low is not None:
            part = part.where((at > low) | at.isNull() if high is None else at > low)
        if high is not None:
            part = part.where(at <= high)
        got = index.admit(part, keys, order, row).where("surplus").select("row")
        found = got if found is None else found.unionByName(got)
    return found

"""Source health as a stream (STM-01, STM-02, STM-09): the fold of ``operators.health`` kept as state."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import ship

STATE = "successes long, failures long, timeouts long, total double, last_ok boolean, last_at double, last_id long, last_error string, last_note string, last_mark string"
OUT = "source_id string, stage string, state string, attempts long, successes long, failures long, timeouts long, avg_ms double, last_error string, note string"


def _text(x: Any) -> str | None:
    return None if x is None or pd.isna(x) else str(x)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """Counters add up; the event that is last by (at, id) decides, whenever it arrives. Marks are no attempts."""
    s, f, t, total, ok, at, id_, error, note, mark = state.get if state.exists else (0, 0, 0, 0.0, True, float("-inf"), -(1 << 62), None, None, None)
    for b in batches:
        tried = b[b["mark"].isna()]
        good = tried["ok"].fillna(False).astype(bool)
        s, f = s + int(good.sum()), f + int((~good).sum())
        t += int((~good & tried["error"].fillna("").str.contains("timeout|timed out|超时", case=False)).sum())
        total += float(tried["elapsed_ms"].fillna(0.0).clip(lower=0.0).sum())
        last = b.sort_values(["at", "id"]).iloc[-1]
        if (last["at"], last["id"]) > (at, id_):
            at, id_, mark, note, error = float(last["at"]), int(last["id"]), _text(last["mark"]), _text(last["note"]), _text(last["error"])
            ok = mark is None and not pd.isna(last["ok"]) and bool(last["ok"])
    state.update((s, f, t, total, ok, at, id_, error, note, mark))
    name = mark or ("healthy" if ok else "degraded" if s > 0 and f <= s else "broken")
    mean = float(Decimal(repr(total / (s + f))).quantize(Decimal("0.001"), ROUND_HALF_EVEN)) if s + f else 0.0
    yield pd.DataFrame([(*key, name, s + f, s, f, t, mean, None if ok or mark else error, (note or "") if ok or mark else "")], columns=[c.split()[0] for c in OUT.split(", ")])


def health_stream(events: DataFrame) -> DataFrame:
    """(source_id, stage, state, ...): after each batch the rows of the keys it touched. Events as in ``operators.health``."""
    ship(events.sparkSession)
    for c in ("note", "mark"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    return events.select("source_id", "stage", "at", "id", "ok", "elapsed_ms", "error", "note", "mark").groupBy("source_id", "stage").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def probe_queue(ids: DataFrame, id: str = "source_id", at: str = "at", span: str = "1 hour") -> DataFrame:
    """STM-02: each id once, however often it is enqueued within ``span``; older ids are forgotten, so the state ends."""
    return ids.withWatermark(at, span).dropDuplicatesWithinWatermark([id])


def started_once(writer: DataStreamWriter, name: str, spark: SparkSession) -> StreamingQuery:
    """STM-09: the running stream of this name, or else a new one."""
    running = next((q for q in spark.streams.active if q.name == name), None)
    return running or writer.queryName(name).start()

"""Pages and size budgets of results (LIM-03 to LIM-05, API-07, API-08, SRT-04, SRT-05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(n: int, low: int = 1, high: int = 200) -> int:
    """LIM-03."""
    return max(low, min(high, n))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """LIM-04: the rows of a page with how many there are in all, and where the next page starts (null at the end).

    The total is a count of its own; the page itself is a sort with a limit.
    """
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    after = F.when(F.col("total") > offset + limit, F.lit(offset + limit))
    return rows.crossJoin(total).withColumns({"has_more": after.isNotNull(), "next_offset": after, "omitted": F.greatest(F.lit(0).cast("bigint"), F.col("total") - offset - limit)})


def within_budget(df: DataFrame, group: str, order: Sequence[Column], chars: int, keep: int = 1) -> DataFrame:
    """LIM-05: of each group the first rows whose JSON text fits the budget together, at least ``keep``.

    The width of a row and the rows' order decide; what is left out goes to a report of the caller's.
    """
    w = Window.partitionBy(group).orderBy(*order)
    sized = df.withColumn("_size", F.length(F.to_json(F.struct(*(F.col(c) for c in df.columns)))))
    out = sized.withColumn("used", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return out.where((F.col("used") <= chars) | (F.col("_n") <= keep)).drop("_size", "_n")


def summary_line(*parts: tuple[str, Column]) -> Column:
    """API-08: one line of "name: value" for people; nulls are left out."""
    return F.concat_ws(", ", *(F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in parts))

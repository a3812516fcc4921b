"""Queries of problem 6: messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity_index import surplus_copies
from ..session import table

KEYS = ["job_id", "kind", "index", "attempt", "saved_at"]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Surplus copies among the chapter and error records of job."""
    jobs = table(spark, folder, "job").where(F.col("kind").isin("chapter", "error")).select("rec_id", "delivered_at", *KEYS)
    return surplus_copies(jobs, KEYS, "delivered_at", "rec_id").select(F.col("row").alias("rec_id"))


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": """
SELECT rec_id FROM (
  SELECT rec_id, row_number() OVER (PARTITION BY job_id, kind, "index", attempt, saved_at
                                    ORDER BY delivered_at NULLS LAST, rec_id) AS n
  FROM job WHERE kind IN ('chapter', 'error'))
WHERE n > 1
"""
}

"""Operator of problem 6: exactly one copy of each message."""

import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscale.operators.identity_index import IdentityIndex, contains, surplus_copies

T0 = datetime(2024, 1, 1)
SCHEMA = "rec_id bigint, job_id string, n int, delivered_at timestamp, row bigint, hi string"
KEYS = ["job_id", "n"]


def expected(rows):
    best = {}
    for r in sorted(rows, key=lambda r: (r[3] is None, r[3] or T0, r[0])):
        best.setdefault((r[1], r[2]), r[0])
    return {r[0] for r in rows if best[r[1], r[2]] != r[0]}


@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), max_size=60), st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), max_size=30))
@settings(max_examples=60, deadline=None)
def test_binary_search(run, wanted):
    arr = np.array(sorted(run), np.int64).reshape(-1, 2)
    hi, lo = np.array([w[0] for w in wanted], np.int64), np.array([w[1] for w in wanted], np.int64)
    assert contains(arr, hi, lo).tolist() == [w in set(run) for w in wanted]


def test_against_brute_force_with_hot_message_nulls_and_ties(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        hot = rnd.random() < 0.34
        job = "hot" if hot else rnd.choice(["a", "b", None, ""])
        rows.append((i, job, 1 if hot else rnd.choice([None, 1, 2, 3]), rnd.choice([None, *(T0 + timedelta(seconds=s) for s in range(40))]), 7, "clash"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(r.row for r in surplus_copies(df, KEYS, "delivered_at", "rec_id", buckets=5).collect()) == sorted(expected(rows))


def test_batches_and_merge(spark):
    index = IdentityIndex(spark, buckets=3, max_runs=2)
    kept = []
    for k in range(5):
        rows = [(k * 10 + i, f"j{i % 4 + k}", 0, T0 + timedelta(days=k), 0, "") for i in range(8)]
        got = index.admit(spark.createDataFrame(rows, SCHEMA), KEYS, "delivered_at", "rec_id")
        kept += [r.row for r in got.collect() if not r.surplus]
    assert len(kept) == 8 and len(index.runs) <= 2
    again = IdentityIndex(spark, index.path)  # the index outlives its object
    assert again.runs == index.runs
    assert all(r.surplus for r in again.admit(spark.createDataFrame([(1, "j0", 0, T0, 0, "")], SCHEMA), KEYS, "delivered_at", "rec_id").collect())


def test_empty(spark):
    assert surplus_copies(spark.createDataFrame([], SCHEMA), KEYS, "delivered_at", "rec_id").count() == 0

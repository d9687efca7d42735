"""Duplicate removal and resume point (FIXTURES F11, F12)."""

import pytest

from revspark.operators import dedupe as DD

SCHEMA = "rid long, votes long, text string"


def test_drop_seen_f11(spark):
    hist = spark.createDataFrame([(1, 5, "r1"), (2, 3, "r2")], SCHEMA)
    batch = spark.createDataFrame([(2, 3, "r2"), (3, 1, "r3"), (3, 1, "r3"), (1, 6, "r1")], SCHEMA)
    got = sorted(tuple(r) for r in DD.drop_seen(batch, hist).collect())
    assert got == [(1, 6, "r1"), (3, 1, "r3")]
    got = sorted(tuple(r) for r in DD.drop_seen(batch, hist, within_batch=False).collect())
    assert got == [(1, 6, "r1"), (3, 1, "r3"), (3, 1, "r3")]
    got = sorted(tuple(r) for r in DD.drop_seen(batch, hist, key_cols=["rid"]).collect())
    assert got == [(3, 1, "r3")]
    assert DD.drop_seen(hist, hist).count() == 0


def test_drop_seen_idempotent(spark):
    hist = spark.createDataFrame([(1, 5, "a")], SCHEMA)
    batch = spark.createDataFrame([(i % 4, 1, "x") for i in range(20)], SCHEMA)
    once = DD.drop_seen(batch, hist)
    twice = DD.drop_seen(once, hist.unionByName(once))
    assert once.count() == 4 and twice.count() == 0


def test_row_key_null_explicit(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 0, "a")], SCHEMA)
    keys = [r[0] for r in df.select(DD.row_key(df.columns)).collect()]
    assert keys[0] != keys[1]


def test_resume_info_f12(spark):
    s = "appid string, timestamp_created long"
    assert DD.resume_info(spark.createDataFrame([("7", 30), ("7", 10)], s)) == DD.ResumeInfo("7", 10)
    assert DD.resume_info(spark.createDataFrame([("NA", 5), ("7", 10)], s)) == DD.ResumeInfo("7", 5)
    with pytest.raises(ValueError):
        DD.resume_info(spark.createDataFrame([("7", 1), ("8", 2)], s))
    assert DD.resume_info(spark.createDataFrame([], s)) == DD.ResumeInfo(None, None)
    assert DD.day_range_for(DD.ResumeInfo("7", 0), 86400 * 3 + 5) == 3


def test_null_order_values_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 1, "a"), (5, 2, "b"), (None, 3, "b"), (None, 4, "c"), (2, 9, None), (1, 8, None)], SCHEMA)
    got = sorted((r.rid, r.votes, r.text) for r in DD.dedupe_rows(df, ["text"], "rid").collect() if r.rid is not None)
    assert got == [(1, 8, None), (5, 2, "b")]
    rest = sorted((r.votes, r.text) for r in DD.dedupe_rows(df, ["text"], "rid").collect() if r.rid is None)
    assert rest == [(1, "a"), (4, "c")]


def test_dedupe_is_a_hash_aggregate(spark):
    df = spark.createDataFrame([(1, 5, "a")], SCHEMA)
    plan = DD.dedupe_rows(df, ["text"], "rid", unique_order=True)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert DD.dedupe_rows(df.union(df)).count() == 1

"""Stratified split: exact per-stratum counts, same rows as a brute-force ranking."""

import hashlib
import math

from revspark.operators import split as SP


def test_split_exact(spark):
    rows = [(i, 1 if i % 7 else 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label int")
    got = {r.id for r in SP.stratified_split(df, "label", "id", 0.25).filter("is_test").collect()}
    expect = set()
    for lab in (0, 1):
        ids = sorted((i for i, l in rows if l == lab),
                     key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        expect |= set(ids[:math.ceil(0.25 * len(ids))])
    assert got == expect


def test_split_partition_and_folds(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(600)], "id long, label int")
    s = SP.stratified_split(df, "label", "id", 0.25)
    assert s.count() == 600
    f = SP.stratified_folds(df, "label", "id", 5)
    assert {r.fold for r in f.select("fold").distinct().collect()} == set(range(5))

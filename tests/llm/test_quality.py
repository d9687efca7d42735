import random

import numpy as np

from helpers import awkward, documents, sentence
from revspark.llm import quality as Q


def test_learns_repetition_on_held_out_rows(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(700):
        good = i % 4 != 0
        text = sentence(rng, rng.randint(30, 80)) if good else " ".join([f"w{rng.randrange(9)}"] * rng.randint(30, 80))
        rows.append((i, text, f"s{i % 3}"))
        if i % 2 or i % 5 == 0:
            labels.append((i, int(good)))
    rows += awkward()
    df = documents(spark, rows)
    model = Q.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = Q.score(df, model, keep=["doc_id"]).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([(r["score"] >= .5) == bool(r["row"]["doc_id"] % 4) for r in out
                    if 60 <= (r["row"]["doc_id"] or 0) < 700]) > 0.98


def test_pseudo_labels_reach_the_other_view():
    rng = np.random.default_rng(1)
    n, u = 80, 3000
    y, hidden = rng.integers(0, 2, n).astype(float), rng.integers(0, 2, u).astype(float)
    xt, ut = y[:, None] + rng.normal(0, .1, (n, 1)), hidden[:, None] + rng.normal(0, .1, (u, 1))
    xm, um = y[:, None] + rng.normal(0, .6, (n, 1)), hidden[:, None] + rng.normal(0, .6, (u, 1))
    def error(rounds):
        m = Q.co_train(xt, xm, y, ut, um, rounds)
        return np.mean((m.meta.logit(um) > 0) != (hidden > 0))
    assert error(5) <= error(0)


def test_no_or_one_sided_labels(spark):
    df = documents(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in Q.score(df, Q.train(df, none), keep=["doc_id"]).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 0)], "doc_id long, quality int")
    assert {r["score"] for r in Q.score(df, Q.train(df, one)).collect()} == {1.0}
    empty = documents(spark, [])
    assert Q.score(empty, Q.train(empty, none)).count() == 0


def test_held_out_accuracy_of_the_table(spark):
    from revspark.llm.queries import QUERIES
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_quality"](spark, d).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.95


def test_repeats_do_not_fill_the_samples(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "co_train", lambda xt, xm, y, ut, um: seen.append((len(y), len(ut))) or Q.Model(0.5))
    rows = [(1, "labelled words", "s")] * 400 + [(5000, "other words", "s")] * 400 + [(i, f"row {i}", "s") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    Q.train(documents(spark, rows), labels)
    assert seen[0][0] <= 39 and seen[0][1] == 40

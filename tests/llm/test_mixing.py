import random

import pytest

from helpers import awkward, documents
from revspark.llm import mixing


def words(text):
    return len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")])


def water_fill(sizes, weights, share=1.5, cap=2):
    """Targets by the rule's own words: cap, reshare the excess by weight, again."""
    left, targets, free = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
            free.remove(i)
    return targets


def test_targets_taken_and_reruns(spark):
    rows = awkward()
    got = [mixing.assign_positions(documents(spark, rows), keep=["doc_id", "text", "source"]).collect() for _ in range(2)]
    assert sorted(map(repr, got[0])) == sorted(map(repr, got[1]))
    names = ["s0", "s1", "s2", None]
    sizes = [sum(words(t) for _, t, s in rows if s == n) for n in names]
    targets = dict(zip(names, water_fill(sizes, [5, 2, 1, 5])))
    assert len(got[0]) == len(rows)
    taken = dict.fromkeys(names, 0)
    for r in got[0]:
        assert r["size"] == words(r["row"]["text"]) and r["source_size"] == sizes[names.index(r["row"]["source"])]
        assert r["target"] == pytest.approx(targets[r["row"]["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["row"]["source"]] += r["taken"]
    for n in names:
        assert abs(taken[n] - targets[n]) <= 12  # ties of a repeated row at most


def test_positions_follow_the_schedule(spark):
    rng = random.Random(3)
    rows = [(i, "x " * rng.randint(1, 9), f"s{i % 3}") for i in range(900)]
    order = mixing.training_order(mixing.assign_positions(documents(spark, rows), keep=["source"])).collect()
    at = [r["position"] for r in order]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    # the first source's weight falls from 1.5 to 0.5: 5/8 of its words come in the first half
    s0 = [r for r in order if r["row"]["source"] == "s0"]
    first = sum(r["words"] for r in s0 if r["position"] < 0.5) / sum(r["words"] for r in s0)
    assert first == pytest.approx(0.625, abs=0.03)


def test_schedule_with_several_knots_inverts_its_integral(spark):
    from pyspark.sql import functions as F
    knots = ((0.0, 1.0), (0.25, 3.0), (1.0, 0.5))
    total, _ = mixing._integrals(knots)
    shares = [i / 20 for i in range(20)]
    df = spark.createDataFrame([(x,) for x in shares], "x double")
    got = [r[0] for r in df.select(mixing.demand_time(F.col("x"), F.lit(0), (knots,))).collect()]
    for x, u in zip(shares, got):
        steps = 20000
        area = sum((1 + 8 * t if t < .25 else 3 - (t - .25) / .75 * 2.5) / steps
                   for t in ((i + .5) / steps for i in range(int(steps * u))))
        assert area / total == pytest.approx(x, abs=1e-3)


def test_mixed_documents_keep_columns_and_cut_once(spark):
    df = documents(spark, awkward())
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    texts = {}
    for r in awkward():
        texts.setdefault(r[0], set()).add(r[1])
    cut = 0
    for r in out.collect():
        if r["text"] not in texts[r["doc_id"]]:
            cut += 1
            assert any(t.split()[:words(r["text"])] == r["text"].split() for t in texts[r["doc_id"]])
            assert r["n_chars"] == len(r["text"])
    assert cut <= 5


def test_empty_table(spark):
    assert mixing.mixed_documents(documents(spark, [])).count() == 0
    assert mixing.assign_positions(documents(spark, [(1, None, "a"), (2, "", None)])).count() == 2

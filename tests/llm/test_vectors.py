import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revspark.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 AS vid", "2 AS vec", "3 AS list", "4 AS uid")


def vectors(n=700, dim=8, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    same = [0.5] * dim
    rows += [(n + i, same) for i in range(200)]  # a large group of ties
    bad = [(2000, None), (2050, [float("nan")] * dim), (2100, [float("inf")] + [0.0] * (dim - 1)), (2150, [None] * dim),
           (2200, [0.0] * dim), (2250, []), (2300, [1.0, 2.0]), (None, same)]
    return rows, bad


def usable(rows, zero_ok):
    return [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if zero_ok or any(v)]


def brute_top(rows, step, k):
    v = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows]
    out = set()
    for qi, q in {i: e for i, e in v if i % step == 0}.items():
        s = sorted(((-sum(a * b for a, b in zip(q, e)), i) for i, e in v if i != qi))[:k]
        out |= {(qi, r, i, -sc) for r, (sc, i) in enumerate(s, 1)}
    return out


def test_topk_equals_brute_force(spark):
    rows, bad = vectors()
    good = rows + [(2200, [0.0] * 8), (5000, [0.25] * 8), (5000, [0.25] * 8)]
    got = topk.top_k(table(spark, good + [b for b in bad if b[0] != 2200]).repartition(5), F.col("vid") % 100 == 0, 10).collect()
    assert {tuple(r) for r in got} == brute_top(good, 100, 10)


def test_topk_few_rows_and_none(spark):
    got = topk.top_k(table(spark, [(0, [1.0]), (3, [-2.0])]), F.col("vid") % 100 == 0, 10).collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, -2 * 1024 * 1024)]
    assert topk.top_k(table(spark, [(0, [1.0])]), F.col("vid") % 100 == 0).count() == 0
    assert topk.top_k(table(spark, []), F.col("vid") % 100 == 0).count() == 0
    assert topk.top_k(table(spark, [(1, [1.0]), (2, None)]), F.col("vid") % 100 == 0).count() == 0


def test_topk_wide_scores_stay_exact():
    q, v = np.array([[2.0 ** 40, 1.0]]), np.array([[2.0 ** 20, 3.0], [2.0 ** 30, 0.0]])
    assert topk.exact_scores(q, v).tolist() == [[2 ** 60 + 3, topk.LIMIT]]


def brute_near(rows, step, k):
    v = np.stack([e for _, e in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for qi, q in {i: e for i, e in rows if i % step == 0}.items():
        s = (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))
        order = np.lexsort((ids, -s))
        out[qi] = [(int(ids[j]), float(s[j])) for j in order if ids[j] != qi][:k]
    return out


def test_ann_recall_and_exact_scores(spark):
    rows, bad = vectors(1500)
    got = ann.nearest(table(spark, rows + bad).repartition(5), F.col("vid") % 50 == 0, 5).collect()
    want = brute_near(usable(rows, False), 50, 5)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hit = 0
    for q, ranked in found.items():
        ranked.sort()
        assert [r for r, _, _ in ranked] == [1, 2, 3, 4, 5]
        hit += len({i for _, i, _ in ranked} & {i for i, _ in want[q]})
        scores = dict(want[q])
        assert all(s == pytest.approx(scores[i], abs=1e-15) for _, i, s in ranked if i in scores)
    assert hit >= 0.95 * 5 * len(want)
    assert [i for _, i, _ in found[1500]] == [1501, 1502, 1503, 1504, 1505]  # exact ties to smaller ids


def test_ann_recall_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in df.collect()]
    want = brute_near(rows, 50, 5)
    got = ann.nearest(df, F.col("vid") % 50 == 0, 5).collect()
    hit = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in got)
    assert hit >= 0.9 * 5 * len(want)


def test_ann_few_rows_and_none(spark):
    is_query = F.col("vid") % 50 == 0
    assert [tuple(r)[:3] for r in ann.nearest(table(spark, [(0, [1.0, 0.0]), (7, [1.0, 1.0])]), is_query).collect()] == [(0, 1, 7)]
    assert ann.nearest(table(spark, [(0, [1.0, 0.0])]), is_query).count() == 0
    assert ann.nearest(table(spark, []), is_query).count() == 0
    assert ann.nearest(table(spark, [(0, [0.0, 0.0]), (3, None)]), is_query).count() == 0
    assert ann.nearest(table(spark, [(1, [1.0]), (2, [2.0])]), is_query).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    c = ann.unit(rng.normal(size=(400, 16)))
    q = ann.unit(rng.normal(size=(50, 16)))
    ids, sim = ann.search_graph(c, ann.link_graph(c), q, 48)
    best = np.argsort(-(q @ c.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b[:8])) / 8 for a, b in zip(best, ids)]) > 0.97
    assert np.allclose(np.take_along_axis(q @ c.T, ids, 1), sim)

"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample (``MAX_SAMPLE`` rows, by hash): k-means,
then lists over twice the mean size are split in two until none is. A graph
joins each centroid to its nearest ones; a beam search on it, in memory, finds the
lists of a vector. Every vector of the table is stored in its nearest list and, near a
boundary, replicated to further lists whose distance is within ``REPLICA_RATIO``
of the nearest. A query searches the lists within ``PROBE_RATIO`` of its nearest,
so a query deep inside a list reads few.

Lists are stored in blocks of about ``BLOCK_ROWS`` rows, and the queries of a list
in blocks of as many, so a list that holds most rows is many tasks. Scores are
cosines in double precision on the original vectors, computed row by row, so equal vectors
tie exactly.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do null ids or vectors of another length than most; a
repeated id is no candidate of its own query, its rows are separate candidates, and it is searched
once, by its smallest vector; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.common import staged
from revspark.llm.vectors import matrix, usable

MAX_SAMPLE = 16_384
#: Rows per list aimed at, and most lists (their centroids go to every task).
LIST_ROWS, MAX_LISTS = 256, 2048
LINKS = 24
REPLICA_RATIO, MAX_REPLICAS = 1.12, 6
#: A query searches the lists within the ratio, at most the larger of a number and a share of all lists.
PROBE_RATIO, MAX_PROBES, PROBE_SHARE = 1.4, 64, 0.125
BLOCK_ROWS = 8192


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares in range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``."""
    sa, sb = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    if sa.max(initial=0) > 1e100 or sb.max(initial=0) > 1e100 or min(sa.min(initial=1), sb.min(initial=1)) < 1e-100:
        a, b = a / sa, b / sb
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of balanced lists over unit vectors."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = np.abs(sums).sum(axis=1) < 1e-9
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = unit(sums + 1e-12)
    parts = [np.flatnonzero(own == i) for i in range(lists) if (own == i).any()]
    most = 2 * len(sample) / lists
    done, todo = [], parts
    while todo:
        part = todo.pop()
        rows = sample[part]
        if len(part) > most:
            mean = rows.mean(axis=0)
            axis = np.linalg.svd(rows[:512] - mean, full_matrices=False)[2][0]
            side = (rows - mean) @ axis > 0
            if side.any() and not side.all():
                todo += [part[side], part[~side]]
                continue
        done.append(unit(rows.sum(axis=0, keepdims=True) + 1e-12)[0])
    return np.array(done)


def link_graph(c: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Neighbour lists (centroids, links): the nearest, then some links across for reach."""
    n = len(c)
    near = min(links * 3 // 4, n - 1)
    s = c @ c.T
    np.fill_diagonal(s, -2)
    nearest = np.argsort(-s, axis=1, kind="stable")[:, :near]
    rng = np.random.default_rng(5)
    far = rng.integers(0, n, size=(n, links - near)) if n > 1 else np.zeros((n, links), dtype=int)
    return np.hstack([nearest, far]).astype(np.int64)


def search_graph(c: np.ndarray, graph: np.ndarray, q: np.ndarray, beam: int):
    """(ids, similarities) of about the ``beam`` nearest centroids of each row of unit ``q``, best first."""
    n, rows = len(c), len(q)
    beam = min(beam, n)
    every = np.arange(rows)
    entry = np.linspace(0, n - 1, min(n, max(4, beam // 4))).astype(np.int64)
    ids = np.full((rows, beam), -1, dtype=np.int64)
    sim = np.full((rows, beam), -3.0)
    open_ = np.zeros((rows, beam), dtype=bool)
    seen = np.zeros((rows, n), dtype=bool)
    ids[:, :len(entry)], sim[:, :len(entry)], open_[:, :len(entry)] = entry, q @ c[entry].T, True
    seen[:, entry] = True
    active = every
    while len(active):
        s = np.where(open_[active], sim[active], -4.0)
        pick = s.argmax(axis=1)
        live = s[np.arange(len(active)), pick] > -3.5
        active, pick = active[live], pick[live]
        if not len(active):
            break
        open_[active, pick] = False
        nbr = graph[ids[active, pick]]
        nbr.sort(axis=1)
        new = ~seen[active[:, None], nbr]
        new[:, 1:] &= nbr[:, 1:] != nbr[:, :-1]  # a neighbour listed twice counts once
        seen[active[:, None], nbr] = True
        got = np.where(new, np.einsum("ijk,ik->ij", c[nbr], q[active]), -3.0)
        all_ids = np.hstack([ids[active], nbr])
        all_sim = np.hstack([sim[active], got])
        all_open = np.hstack([open_[active], new])
        top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        at = np.arange(len(active))[:, None]
        ids[active], sim[active], open_[active] = all_ids[at, top], all_sim[at, top], all_open[at, top]
    best = np.argsort(-sim, axis=1, kind="stable")
    return ids[every[:, None], best], sim[every[:, None], best]


def _distance(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * sim))


def _lists_of(c, graph, dim, ratio, most):
    """Task: one row per vector and list within ``ratio`` of its nearest list's distance."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                v = matrix(part.column("vec"), dim)
                ids, sim = search_graph(c, graph, unit(v), max(24, most))
                d = _distance(sim[:, :most])
                keep = (d <= d[:, :1] * ratio + 1e-9) & (ids[:, :most] >= 0)
                row, col = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row, col], pa.int64())] + [part.column(x).take(pa.array(row)) for x in ("uid", "vid", "vec")],
                    names=["list", "uid", "vid", "vec"])
    return run


def _search_block(k: int):
    """Task: best k rows of one list block for each query of one query block."""
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            v = np.stack(rows["vec"].to_numpy())
            vid, uid = rows["vid"].to_numpy(), rows["uid"].to_numpy()
            vu = unit(v)
            for at in range(0, len(queries), 512):
                q = np.stack(queries["vec"].to_numpy()[at:at + 512])
                qid = queries["vid"].to_numpy()[at:at + 512]
                s = unit(q) @ vu.T
                s[qid[:, None] == vid[None, :]] = -3
                kth = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
                # all that rounding could bring among the best, then exact scores row by row
                i, j = np.nonzero((s >= kth[:, None] - 1e-9) & (s > -2))
                exact = np.empty(len(i))
                for cut in range(0, len(i), 65536):
                    a, b = i[cut:cut + 65536], j[cut:cut + 65536]
                    exact[cut:cut + 65536] = cosine(q[a], v[b])
                order = np.lexsort((uid[j], vid[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                top = rank < k
                out.append(pd.DataFrame({"query_id": qid[i[top]], "uid": uid[j[top]], "vec_id": vid[j[top]],
                                         "score": exact[top]}))
        return (pd.concat(out) if out else
                pd.DataFrame({"query_id": [], "uid": [], "vec_id": [], "score": []})).astype(
            {"query_id": "int64", "uid": "int64", "vec_id": "int64", "score": "float64"})
    return run


def nearest(table: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k nearest found of each query.

    ``is_query`` is a condition on the column ``vid`` (the id).
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    sizes = (rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.col("n").desc(), "d").limit(1).collect())
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["d"], sizes[0]["n"]
    rows = rows.where(F.size("vec") == dim)
    hashed = F.pmod(F.xxhash64(F.lit(5), "vid"), F.lit(1 << 30))
    share = min(1.0, MAX_SAMPLE / n)
    sample = rows.where(hashed < int(share * (1 << 30))).select("vec").collect()
    if not sample:
        sample = rows.select("vec").limit(1).collect()
    c = fit_centroids(unit(np.array([r["vec"] for r in sample])), min(MAX_LISTS, math.ceil(n / LIST_ROWS)))
    graph = link_graph(c)
    probes = max(MAX_PROBES, math.ceil(len(c) * PROBE_SHARE))

    schema = "list long, uid long, vid long, vec array<double>"
    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "vid", "vec")
    postings = staged(numbered.mapInArrow(_lists_of(c, graph, dim, REPLICA_RATIO, MAX_REPLICAS), schema), "postings")
    queries = rows.where(is_query).groupBy("vid").agg(F.min("vec").alias("vec"))
    queries = queries.select(F.lit(0).cast("long").alias("uid"), "vid", "vec")
    asked = staged(queries.mapInArrow(_lists_of(c, graph, dim, PROBE_RATIO, probes), schema), "asked")

    def blocks(df, name):  # one row a list, at most twice MAX_LISTS
        return df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))

    sizes = F.broadcast(blocks(postings, "pb").join(blocks(asked, "qb"), "list"))

    def dealt(df, own, other, own_name, other_name):
        return (df.join(sizes, "list")
                .withColumn(own_name, F.pmod(F.xxhash64(F.lit(6), "uid", "vid"), F.col(own)).cast("int"))
                .withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .select("list", "v", "q", "uid", "vid", "vec"))

    left = dealt(postings, "pb", "qb", "v", "q")
    right = dealt(asked, "qb", "pb", "q", "v")
    found = (left.groupBy("list", "v", "q").cogroup(right.groupBy("list", "v", "q"))
             .applyInPandas(_search_block(k), "query_id long, uid long, vec_id long, score double"))
    found = found.groupBy("query_id", "uid").agg(F.max("vec_id").alias("vec_id"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "uid")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

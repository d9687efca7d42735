"""Exact top-k inner products by distributed histogram selection.

All candidates are scored against a block of queries in every pass. A pass
counts the scores inside each query's current range in equal bins; summed over
all tasks, the bins say which one holds the query's kth best score, and that bin
is the next range. When a bin is one score wide the kth value is exact. A last
pass keeps the scores at or above it and breaks ties by the smaller id.

What moves is counts (at most ``BINS`` a query and task) and, at the end, at
most k rows a query and task. Queries are taken in hashed blocks of about
``BLOCK``; only one block is sent to the tasks at a time.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do null ids or vectors of another length than most;
a repeated id stays a separate candidate, but is no candidate of the query of its
id, and is searched once, by its smallest vector; with fewer than k candidates
all come back; an empty table gives no rows. Scores beyond +-2**62 count as that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.vectors import matrix, usable

BINS = 1024
#: Queries of a block, on average; a block's vectors and thresholds go to every task.
BLOCK = 2048
SCALE = 1024.0
LIMIT = 1 << 62


def quantised(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products (queries, vectors) as int64, exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if bound < 2.0 ** 53:  # every partial sum is an exact double
        return np.rint(q @ v.T).astype(np.int64)
    to_int = np.frompyfunc(int, 1, 1)
    wide = np.dot(to_int(q), to_int(v).T)
    return np.vectorize(lambda x: max(-LIMIT, min(LIMIT, x)), otypes=[np.int64])(wide)


def _without_own(scores: np.ndarray, qid: np.ndarray, vid: np.ndarray) -> np.ndarray:
    """Mask of candidates: every row but those of the query's own id."""
    return qid[:, None] != vid[None, :]


def _histogram(qid, q, lo, hi, width, dim):
    """Task: count scores of [lo, hi) per query and bin of ``width``."""
    def run(batches):
        counts = np.zeros((len(qid), BINS), dtype=np.int64)
        for b in batches:
            vid = b.column("vid").to_numpy()
            for at in range(0, len(vid), 2048):
                block = matrix(b.column("vec").slice(at, 2048), dim)
                s = exact_scores(q, quantised(block))
                ok = _without_own(s, qid, vid[at:at + 2048])
                bins = (s - lo[:, None]) // width[:, None]
                ok &= (s >= lo[:, None]) & (s < hi[:, None])
                flat = (np.arange(len(qid))[:, None] * BINS + bins)[ok]
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"q": pa.array(i, pa.int32()), "bin": pa.array(j, pa.int32()),
                                          "n": pa.array(counts[i, j], pa.int64())})
    return run


def _select(qid, q, least, dim, k):
    """Task: its best k candidates per query among scores of at least ``least``."""
    def run(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2 for _ in qid]
        for b in batches:
            vid = b.column("vid").to_numpy()
            for at in range(0, len(vid), 2048):
                ids = vid[at:at + 2048]
                s = exact_scores(q, quantised(matrix(b.column("vec").slice(at, 2048), dim)))
                ok = _without_own(s, qid, ids) & (s >= least[:, None])
                for i in np.nonzero(ok.any(axis=1))[0]:
                    sc = np.concatenate([best[i][0], s[i, ok[i]]])
                    vi = np.concatenate([best[i][1], ids[ok[i]]])
                    top = np.lexsort((vi, -sc))[:k]
                    best[i] = (sc[top], vi[top])
        rows = [len(x[0]) for x in best]
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(np.repeat(qid, rows), pa.int64()),
            "vec_id": pa.array(np.concatenate([x[1] for x in best]), pa.int64()),
            "score": pa.array(np.concatenate([x[0] for x in best]), pa.int64())})
    return run


def kth_values(vectors: DataFrame, qid, q, k: int, dim: int, most: float) -> np.ndarray:
    """Exact kth best score of each query of the block (its least score, if it has fewer)."""
    n = len(qid)
    bound = np.minimum(np.ceil(np.abs(q).sum(axis=1) * most) + 1, float(LIMIT)).astype(np.int64)
    lo, hi, above = -bound, bound + 1, np.zeros(n, dtype=np.int64)
    width = 2 * (bound // BINS) + 3  # BINS of them reach past the bound
    while True:
        counts = (vectors.mapInArrow(_histogram(qid, q, lo, hi, width, dim), "q int, bin int, n long")
                  .groupBy("q", "bin").agg(F.sum("n").alias("n")))
        seen = Window.partitionBy("q").orderBy(F.col("bin").desc())
        ahead = F.sum("n").over(seen) - F.col("n")
        # one row a query: its kth score's bin, or its lowest bin if it has fewer than k
        offsets = vectors.sparkSession.createDataFrame(
            pd.DataFrame({"q": np.arange(n, dtype=np.int32), "above": above}))
        found = (counts.withColumn("ahead", ahead).join(F.broadcast(offsets), "q")  # a block's rows
                 .where(F.col("ahead") + F.col("above") < k)
                 .groupBy("q").agg(F.min("bin").alias("bin"), F.max("ahead").alias("ahead")).collect())
        if not found:
            return np.full(n, -LIMIT, dtype=np.int64)
        new_lo, new_above = lo.copy(), above.copy()
        for r in found:
            new_lo[r["q"]] = lo[r["q"]] + r["bin"] * width[r["q"]]
            new_above[r["q"]] = above[r["q"]] + r["ahead"]
        if (width == 1).all():
            return new_lo
        lo, hi, above = new_lo, np.minimum(new_lo + width, hi), new_above
        width = np.maximum(1, -(-width // BINS))


def top_k(table: DataFrame, is_query: Column, k: int = 10, *, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's k best candidates.

    ``is_query`` is a condition on the column ``vid`` (the id).
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vec_col)
    sizes = (rows.groupBy(F.size("vec").alias("d"))
             .agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("nq"),
                  F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))).alias("most"))
             .orderBy(F.col("n").desc(), "d").limit(1).collect())
    schema = "query_id long, rank int, vec_id long, score long"
    if not sizes or not sizes[0]["nq"]:
        return spark.createDataFrame([], schema)
    dim, most = sizes[0]["d"], sizes[0]["most"] * SCALE + 1
    rows = rows.where(F.size("vec") == dim)
    queries = rows.where(is_query).groupBy("vid").agg(F.min("vec").alias("vec"))
    blocks = -(-sizes[0]["nq"] // BLOCK)
    out = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vid"), F.lit(blocks)) == i).orderBy("vid").collect()
        if not block:
            continue
        qid = np.array([r["vid"] for r in block], dtype=np.int64)
        q = quantised(np.array([r["vec"] for r in block], dtype=np.float64))
        least = kth_values(rows, qid, q, k, dim, most)
        part = rows.mapInArrow(_select(qid, q, least, dim, k), "query_id long, vec_id long, score long")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

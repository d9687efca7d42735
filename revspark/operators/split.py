"""Deterministic stratified train/test split and stratified folds.

Order inside a stratum is ``md5("<seed>:<id>")``; the test set is the first
``ceil(fraction * n)`` rows of each stratum. A stratum can hold most of the
rows (two labels!), so the exact cut is found without sorting a stratum in one
task: rows are bucketed by the first 16 bits of their hash, bucket counts are
aggregated (map-side combined), cumulative counts per stratum locate the one
boundary bucket; the same is repeated on the next 16 bits inside it, and only
the rows sharing the first 32 bits at the cut (~n / 2^32) are ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.functions import constants as K

BUCKET_HEX = 4  # 16-bit buckets


def order_hash(id_col: str, seed: int = K.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, label_col: str, id_col: str, test_fraction: float = 0.25,
                     seed: int = K.SEED, exact: bool = True) -> DataFrame:
    """``df`` plus a boolean ``is_test``; exactly ``ceil(fraction * n_s)`` test rows per stratum.

    ``exact=False`` compares the hash with the per-stratum quantile from
    ``percentile_approx`` instead (one aggregation, no boundary ranking).
    """
    h = df.withColumn("_h", order_hash(id_col, seed))
    if not exact:
        hnum = F.conv(F.substring("_h", 1, 15), 16, 10).cast("bigint")
        h = h.withColumn("_hn", hnum)
        q = h.groupBy(label_col).agg(F.percentile_approx("_hn", test_fraction, 100000).alias("_q"))
        return h.join(F.broadcast(q), label_col).withColumn("is_test", F.col("_hn") <= F.col("_q")) \
            .drop("_h", "_hn", "_q")
    h = (h.withColumn("_b", F.substring("_h", 1, BUCKET_HEX))
         .withColumn("_b2", F.substring("_h", BUCKET_HEX + 1, BUCKET_HEX)))
    counts = h.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_c"))
    n = counts.groupBy(label_col).agg(F.sum("_c").alias("_n"))
    need = n.select(label_col, F.ceil(F.col("_n") * F.lit(test_fraction)).cast("bigint").alias("_k"))
    # level 1: the 16-bit bucket holding the cut, and how many rows it must give
    b1 = _boundary(counts.join(F.broadcast(need), label_col), label_col, "_b", "_k") \
        .select(label_col, F.col("_bkt").alias("_bb"), F.col("_need").alias("_need1"))
    j = h.join(F.broadcast(b1), label_col, "left")
    clear1 = j.filter(F.col("_bb").isNull() | (F.col("_b") != F.col("_bb"))) \
        .withColumn("is_test", F.coalesce(F.col("_b") < F.col("_bb"), F.lit(False)))
    # level 2: inside that bucket, the next 16 bits
    inner = j.filter(F.col("_b") == F.col("_bb"))
    counts2 = inner.groupBy(label_col, "_b2", "_need1").agg(F.count(F.lit(1)).alias("_c"))
    b2 = _boundary(counts2, label_col, "_b2", "_need1") \
        .select(label_col, F.col("_bkt").alias("_bb2"), F.col("_need").alias("_need2"))
    j2 = inner.join(F.broadcast(b2), label_col, "left")
    clear2 = j2.filter(F.col("_bb2").isNull() | (F.col("_b2") != F.col("_bb2"))) \
        .withColumn("is_test", F.coalesce(F.col("_b2") < F.col("_bb2"), F.lit(False)))
    # only the rows sharing the first 32 hash bits at the cut are ranked
    edge = j2.filter(F.col("_b2") == F.col("_bb2"))
    edge = edge.withColumn("is_test", F.row_number().over(
        Window.partitionBy(label_col).orderBy("_h")) <= F.col("_need2"))
    helpers = ["_h", "_b", "_b2", "_bb", "_need1", "_bb2", "_need2"]
    return (clear1.drop(*[c for c in helpers if c in clear1.columns])
            .unionByName(clear2.drop(*[c for c in helpers if c in clear2.columns]))
            .unionByName(edge.drop(*[c for c in helpers if c in edge.columns])))


def _boundary(counts: DataFrame, label_col: str, bucket: str, need: str) -> DataFrame:
    """Per label: the first bucket (in hash order) whose cumulative count reaches
    ``need``, and how many of its rows are still needed. One row per label."""
    w = Window.partitionBy(label_col).orderBy(bucket)
    cum = counts.withColumn(
        "_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (cum.filter(F.col("_cum") >= F.col(need))
            .groupBy(label_col)
            .agg(F.min(F.struct(bucket, "_cum", "_c", need)).alias("_m"))
            .select(label_col, F.col(f"_m.{bucket}").alias("_bkt"),
                    (F.col(f"_m.{need}") - (F.col("_m._cum") - F.col("_m._c"))).alias("_need")))


def stratified_folds(df: DataFrame, label_col: str, id_col: str, k: int = 5,
                     seed: int = K.SEED) -> DataFrame:
    """``df`` plus an int ``fold`` in ``0..k-1``: in each stratum the folds differ by one row at most.

    The fold is the row's rank in the stratum's hash order, modulo ``k``. Ranks come from counts
    per 16-bit bucket of the hash, so a stratum is ranked by many tasks. Rows of equal id tie.
    """
    h = df.withColumn("_h", order_hash(id_col, seed + 1)).withColumn("_b", F.substring("_h", 1, BUCKET_HEX))
    label = F.col(label_col)
    counts = h.groupBy(label.alias("_s"), F.col("_b").alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_s").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_t", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy(label_col, "_b").orderBy("_h")) - 1
    placed = h.withColumn("_r", rank).join(offsets, label.eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_t")))
    return placed.select(*[F.col(c) for c in df.columns], F.pmod(F.col("_r") + F.col("_off"), F.lit(k)).cast("int").alias("fold"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.session import scratch_path, worker_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the written table.

    Cuts lineage with a table every executor can read, so a lost executor costs
    a re-read, never a recomputation that might draw other row positions.
    """
    worker_path(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`staged` that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents no model learns from (null ids too)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def ranked(rows: DataFrame, key: list[str], bucket: str, order: list, out: str = "rank") -> DataFrame:
    """Zero-based position of each row within ``key``, ordered by (bucket, order).

    ``bucket`` must be monotone in the order wanted. Each (key, bucket) group is
    sorted alone and shifted by the number of rows in the key's earlier buckets,
    so a key that holds most rows is still ranked by many tasks.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(*key, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*key, bucket).orderBy(*order)
    return (rows.withColumn("_r", F.row_number().over(local) - 1)
            .join(offsets, [*key, bucket])
            .withColumn(out, (F.col("_r") + F.col("_off")).cast("long"))
            .drop("_r", "_off"))


#: Most rows, and bytes of their columns as Spark estimates them, of a table that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def sized_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` marked for broadcast if it is counted to be small, else as it is (joined by shuffle).

    ``table`` should be a staged one, as counting reads it.
    """
    widths = [F.sum(F.coalesce(F.length(c), F.lit(0))) if t in ("string", "binary") else F.sum(F.coalesce(F.size(c), F.lit(0))) * 32
              for c, t in table.dtypes if t in ("string", "binary") or t.startswith("array")]
    found = table.agg(F.count(F.lit(1)), *widths).first()
    heavy = sum(int(x or 0) for x in found[1:]) + 16 * found[0] * len(table.columns)
    return F.broadcast(table) if found[0] <= rows and heavy <= size else table

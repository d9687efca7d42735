"""Uniform shuffle into shards of exact size by a communication matrix.

Every scan partition (block) permutes its rows locally by a hash of their place in it
(beyond ``MAX_BLOCKS`` partitions, several make a block, permuted after an exchange). How many rows
block i sends to shard j is drawn beforehand from the multivariate hypergeometric
law, so shard sizes are exact and the result is a uniform shuffle; a block then
deals its permuted rows out by its row of the matrix. After the exchange each
shard permutes what it got, by buckets of a second hash.

DataFrame functions only. Block and place are written once, to the shared
checkpoint folder, so a task run again cannot place a row differently.

Defined results: a null text has no bytes (size 8, checksum 0); null ids and
fully repeated rows are rows like any others, each with a place of its own, so copies
are scattered too; rows tie on no key; an empty table gives no rows.
Only id and text are read, whatever else the table has.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import ranked, staged

#: Most blocks, hence most rows of the matrix the driver draws (times the shards).
MAX_BLOCKS = 4096
#: Rows of a shard that one task permutes on average.
BUCKET_ROWS = 65536


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good balls among ``draws`` from good + bad, by inversion from the mode."""
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - p
    left, right, pl, pr = mode, mode, p, p
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > lo:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return mode


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard; shard totals differ by one at most."""
    total = sum(block_rows)
    rng = random.Random(seed)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in block_rows:
        row, rest, left = [], sum(room), n
        for j in range(shards):
            k = hypergeometric(rng, room[j], rest - room[j], left)
            row.append(k)
            rest -= room[j]
            left -= k
        room = [r - k for r, k in zip(room, row)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text",
                        seed: int = 17) -> DataFrame:
    """One row per document: ``id_col``, ``size``, ``text_crc32``, ``shard``, ``slot``."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    # the place a row was read from tells copies apart; it is fixed once written
    local = rows.withColumn("_row", F.monotonically_increasing_id())
    local = local.sortWithinPartitions(F.xxhash64(F.lit(seed), "_row"), "_row")
    local = staged(local.select(id_col, "size", "text_crc32", F.monotonically_increasing_id().alias("_place")), "shard-blocks")
    local = (local.withColumn("_block", F.shiftright("_place", 33))
             .withColumn("_at", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))))
    last = local.agg(F.max("_block")).first()[0]
    if last is not None and last >= MAX_BLOCKS:  # several scan partitions are one block, permuted as one
        local = (local.withColumn("_block", F.pmod("_block", F.lit(MAX_BLOCKS)))
                 .withColumn("_h0", F.xxhash64(F.lit(seed + 2), "_place"))
                 .withColumn("_part", F.shiftrightunsigned("_h0", 56)))
        local = ranked(local.drop("_at"), ["_block"], "_part", [F.shiftrightunsigned("_h0", 1), "_place"], out="_at").drop("_h0", "_part")
        local = staged(local, "shard-joined-blocks")

    # at most MAX_BLOCKS rows, whatever the input
    counts = {r["_block"]: r["n"] for r in local.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = sorted(counts)
    matrix = communication_matrix([counts[b] for b in blocks], shards, seed)
    total = sum(counts.values())
    cuts = [(b, [sum(row[:j + 1]) for j in range(shards)]) for b, row in zip(blocks, matrix)]
    cut_table = spark.createDataFrame(cuts, "_block long, _cuts array<long>")
    shard = F.size(F.filter("_cuts", lambda c: c <= F.col("_at")))
    dealt = (local.join(F.broadcast(cut_table), "_block")  # bounded: MAX_BLOCKS rows of `shards` numbers
             .withColumn("shard", shard.cast("int")))

    buckets = max(1, -(-total // (shards * BUCKET_ROWS)))
    dealt = (dealt.withColumn("_h2", F.xxhash64(F.lit(seed + 1), "_place"))
             .withColumn("_bucket", F.floor(F.shiftrightunsigned("_h2", 32) / F.lit(float(1 << 32)) * buckets)
                         .cast("long")))
    out = ranked(dealt, ["shard"], "_bucket", ["_h2", "_place"], out="slot")
    return out.select(id_col, "size", "text_crc32", "shard", "slot")

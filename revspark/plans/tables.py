"""Access to the input tables of a scale-factor folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Tables whose rows carry whole texts (per-row regex and tokenising dominates).
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}
# Session setting: spread text tables over this many tasks. Unset (the default) the scan's
# own splits are kept; a laptop run on one small file, which is a single split, sets it.
SPREAD_CONF = "spark.revspark.textPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table; Catalyst prunes columns and pushes filters into it."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    spread = spark.conf.get(SPREAD_CONF, None)
    return df.repartition(int(spread)) if spread and name in TEXT_TABLES else df

"""Row identity, duplicate removal against stored rows, and the resume point.

Scale notes. A single text (or review) may be repeated in a third of all rows,
so every step first collapses duplicates with a partial aggregation (one row
per key per map task) before anything is shuffled by key:

* ``dedupe_rows`` finds the smallest order value per key by a hash aggregate that
  combines map side, then fetches those rows by (key, value);
* ``drop_seen`` reduces the history to distinct keys, dedupes the batch, and
  only then runs the anti-join, so no key is hot on either side; with
  ``within_batch=False`` AQE's skew-join splitting covers a hot batch key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revspark.functions import constants as K

KEY = "row_key"


def row_key(cols) -> Column:
    """Content hash over ``cols`` (SHA-256 of their JSON, nulls kept explicit).

    Value based: equal values give equal keys whatever the source. 256 bits, so
    collisions are not a concern at any scale (a 64-bit hash is not safe).
    """
    st = F.struct(*[F.col(c) for c in cols])
    return F.sha2(F.to_json(st, {"ignoreNullFields": "false"}), 256)


def with_row_key(df: DataFrame, key_cols=None, name: str = KEY) -> DataFrame:
    cols = list(key_cols) if key_cols else [c for c in df.columns if c != name]
    return df.withColumn(name, row_key(cols))


def dedupe_rows(df: DataFrame, key_cols=None, order_col: str | None = None,
                unique_order: bool = False) -> DataFrame:
    """One row per key. With ``order_col`` the row with the smallest value is kept.

    A NULL order value counts as largest: it is kept only when the key has no other.
    The smallest value per key is a hash aggregate of two small columns; the rows
    are then fetched by a semi-join on (key, value), which no hot key skews. Rows that tie on it
    are cut to one, which ``unique_order`` (the column is an id) makes unnecessary.
    """
    if order_col is None:
        if key_cols is None or set(key_cols) == set(df.columns):
            return df.distinct()
        return with_row_key(df, key_cols).dropDuplicates([KEY]).drop(KEY)
    keyed = with_row_key(df, key_cols)
    best = keyed.groupBy(KEY).agg(F.min(order_col).alias("_best")).withColumnRenamed(KEY, "_key")
    first = keyed.join(best, (keyed[KEY] == best["_key"]) & keyed[order_col].eqNullSafe(best["_best"]),
                       "left_semi")
    if not unique_order:
        first = first.dropDuplicates([KEY])
    return first.select(*df.columns)


def drop_seen(new: DataFrame, hist: DataFrame, key_cols=None, within_batch: bool = True,
              order_col: str | None = None, unique_order: bool = False,
              earliest: bool = False) -> DataFrame:
    """Rows of ``new`` whose key is not among the stored rows ``hist``.

    ``key_cols`` default: all columns of ``new``. ``within_batch`` also removes
    repeats inside ``new`` (keeping the row with the smallest ``order_col`` when
    given); ``within_batch=False`` keeps them, as a filter that compares the
    whole batch with the stored set only. ``earliest`` lets a stored row hide only those that
    are not before it in ``order_col`` (a NULL counts as largest).
    """
    cols = list(key_cols) if key_cols else list(new.columns)
    batch = dedupe_rows(new, cols, order_col, unique_order) if within_batch else new
    if earliest:
        seen = hist.groupBy(row_key(cols).alias("_key")).agg(F.min(order_col).alias("_least"))
        keyed = batch.withColumn(KEY, row_key(cols))
        hides = (F.col(KEY) == F.col("_key")) & (F.col(order_col).isNull() | (F.col("_least") <= F.col(order_col)))
        return keyed.join(seen, hides, "left_anti").drop(KEY)
    seen = hist.select(row_key(cols).alias(KEY)).distinct()
    return (batch.withColumn(KEY, row_key(cols))
            .join(seen, KEY, "left_anti").drop(KEY))


@dataclass(frozen=True)
class ResumeInfo:
    appid: str | None
    oldest_created: int | None


def resume_info(hist: DataFrame, appid_col: str = "appid",
                ts_col: str = "timestamp_created") -> ResumeInfo:
    """Product id and oldest creation time of the stored rows (one small action).

    "NA" ids are ignored; more than one real product id is an error. An empty
    table gives ``ResumeInfo(None, None)``.
    """
    row = hist.agg(
        F.min(ts_col).alias("oldest"),
        F.count_distinct(F.when(F.col(appid_col) != F.lit(K.MISSING_TITLE), F.col(appid_col)))
        .alias("n_ids"),
        F.min(F.when(F.col(appid_col) != F.lit(K.MISSING_TITLE), F.col(appid_col))).alias("appid"),
    ).first()
    if row["n_ids"] > 1:
        raise ValueError(f"stored rows hold {row['n_ids']} product ids; expected one")
    return ResumeInfo(row["appid"], row["oldest"])


def resume_points(hist: DataFrame, as_of: Column, appid_col: str = "appid",
                  ts_col: str = "timestamp_created") -> DataFrame:
    """Per product: oldest stored creation time and the day range to re-read from it."""
    from revspark.functions.decode import days_since
    agg = hist.filter(F.col(appid_col) != F.lit(K.MISSING_TITLE)) \
        .groupBy(appid_col).agg(F.min(ts_col).alias("oldest_created"),
                                F.count(F.lit(1)).alias("n_stored"))
    return agg.withColumn("day_range", days_since(F.col("oldest_created"), as_of))


def day_range_for(info: ResumeInfo, as_of: int) -> int | None:
    """Whole days from the oldest stored review to ``as_of`` (truncated)."""
    if info.oldest_created is None:
        return None
    days = int((as_of - info.oldest_created) / 86400)
    if days < 0:
        raise ValueError("oldest stored review lies in the future")
    return days

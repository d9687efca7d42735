"""Nested review pages -> typed flat review rows, and the title attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.functions import constants as K
from revspark.functions.decode import normalize_language, to_double_or_zero, to_id
from revspark.schemas import FLAT_COLUMNS


def explode_reviews(pages: DataFrame, keep=()) -> DataFrame:
    """One row per review of each page (``r``); empty pages give no rows."""
    return pages.select(*keep, F.explode_outer("reviews").alias("r")).filter(F.col("r").isNotNull())


def flatten_reviews(pages: DataFrame, title=None, appid=None, extra: bool = False,
                    with_validity: bool = False) -> DataFrame:
    """Page envelopes -> the 18-column flat review table.

    ``title``/``appid`` are column names on ``pages`` (or literals); missing ones
    become "NA". The developer reply defaults to "". Ids are decoded from their
    string form. A row whose ids or language do not decode is rejected; ``with_validity``
    keeps it and adds ``is_valid``/``reject_reason``. ``extra`` keeps the
    order-mode columns (update time, vote score) that the flat table drops.
    """
    keep = [c for c in (title, appid) if isinstance(c, str) and c in pages.columns]
    rows = explode_reviews(pages, keep)
    t = F.col(title) if isinstance(title, str) and title in pages.columns else F.lit(title)
    a = F.col(appid) if isinstance(appid, str) and appid in pages.columns else F.lit(appid)
    out = [
        F.coalesce(t.cast("string"), F.lit(K.MISSING_TITLE)).alias("title"),
        F.coalesce(a.cast("string"), F.lit(K.MISSING_TITLE)).alias("appid"),
        to_id("r.recommendationid").alias("recommendation_id"),
        to_id("r.author.steamid").alias("steam_id"),
        F.col("r.author.num_games_owned").alias("num_games_owned"),
        F.col("r.author.num_reviews").alias("num_reviews"),
        F.col("r.author.playtime_forever").alias("playtime_forever"),
        normalize_language("r.language").alias("language"),
        F.col("r.review").alias("review"),
        F.col("r.timestamp_created").alias("timestamp_created"),
        F.col("r.voted_up").alias("voted_up"),
        F.col("r.votes_up").alias("votes_up"),
        F.col("r.votes_funny").alias("votes_funny"),
        F.col("r.comment_count").alias("comment_count"),
        F.col("r.steam_purchase").alias("steam_purchase"),
        F.col("r.received_for_free").alias("received_for_free"),
        F.col("r.written_during_early_access").alias("written_during_early_access"),
        F.coalesce(F.col("r.developer_response"), F.lit("")).alias("developer_response"),
    ]
    if extra:
        out += [F.col("r.timestamp_updated").alias("timestamp_updated"),
                to_double_or_zero("r.weighted_vote_score").alias("weighted_vote_score")]
    flat = rows.select(*out)
    bad_id = F.col("recommendation_id").isNull()
    bad_author = F.col("steam_id").isNull()
    bad_language = F.col("language").isNull()
    if not with_validity:
        return flat.filter(~(bad_id | bad_author | bad_language))
    reason = (F.when(bad_id, F.lit("bad recommendationid")).when(bad_author, F.lit("bad steamid"))
              .when(bad_language, F.lit("unknown language")))
    return (flat.withColumn("reject_reason", reason)
            .withColumn("is_valid", F.col("reject_reason").isNull()))


def attach_title(reviews: DataFrame, titles: DataFrame, on: str = "appid") -> DataFrame:
    """Fill ``title`` from a title dimension ``(appid, title)``; "NA" when absent.

    Of several pages of one product the least title counts. AQE broadcasts it when its measured
    size is small and falls back to a shuffle join otherwise.
    """
    dim = titles.groupBy(on).agg(F.min("title").alias("_title"))
    out = reviews.drop("title").join(dim, on, "left")
    out = out.withColumn("title", F.coalesce("_title", F.lit(K.MISSING_TITLE))).drop("_title")
    cols = [c for c in FLAT_COLUMNS if c in out.columns]
    return out.select(*cols, *[c for c in out.columns if c not in cols])


def add_vote_label(df: DataFrame, name: str = "up_funny") -> DataFrame:
    """Derived label: more helpful votes than funny votes."""
    return df.withColumn(name, F.col("votes_up") > F.col("votes_funny"))


def to_sentiment_schema(reviews: DataFrame) -> DataFrame:
    """Flat review table -> the sentiment table read by the analysis half."""
    return reviews.select(
        "title",
        F.col("review").alias("user_review"),
        F.col("voted_up").cast("int").alias("user_suggestion"),
        "votes_up", "votes_funny")

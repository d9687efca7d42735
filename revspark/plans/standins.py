"""Review tables derived from the driver's tables.

``flat_reviews`` joins documents (text, title, language), labels (recommendation
flag) and events (time, author, votes) into the 18-column flat review table;
``review_pages`` nests the same rows into page envelopes (at most 100 reviews
per page, the request cap) the way the source delivers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.functions.decode import normalize_language, unix_seconds_of
from revspark.plans.tables import table

DEV_REPLY = "We are looking into it."
#: Deliveries of the event stream.
EVENT_FILES = 4
#: Micro-batches in which the stored page files are streamed.
PAGE_BATCHES = 4


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value",
                                              "props")
    return d.join(lab, "doc_id", "left").join(e, F.col("doc_id") == F.col("event_id"), "left")


def flat_reviews(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    j = _joined(spark, sf_dir)
    cols = [
        F.col("source").alias("title"),
        F.regexp_extract("source", r"([0-9]+)$", 1).alias("appid"),
        F.col("doc_id").alias("recommendation_id"),
        F.col("user_id").alias("steam_id"),
        F.col("user_id").alias("num_games_owned"),
        (F.col("n_chars").cast("bigint") / 1000).cast("bigint").alias("num_reviews"),
        F.floor(F.col("value") * 60).cast("bigint").alias("playtime_forever"),
        normalize_language("lang").alias("language"),
        F.col("text").alias("review"),
        unix_seconds_of("ts").alias("timestamp_created"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("voted_up"),
        F.floor("value").cast("bigint").alias("votes_up"),
        F.get_json_object("props", "$.k").cast("bigint").alias("votes_funny"),
        (F.col("n_chars") / 1000).cast("bigint").alias("comment_count"),
        (F.col("event_type") == "purchase").alias("steam_purchase"),
        (F.col("event_type") == "signup").alias("received_for_free"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("written_during_early_access"),
        F.coalesce(F.when(F.col("event_type") == "error", F.lit(DEV_REPLY)), F.lit(""))
        .alias("developer_response"),
    ]
    if extra:
        cols += [
            (unix_seconds_of("ts") + F.floor(F.col("value") * 3600).cast("bigint"))
            .alias("timestamp_updated"),
            F.round(F.col("value") / 500.0, 6).alias("weighted_vote_score"),
        ]
    return j.select(*cols)


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page envelopes ``(title, appid, success, cursor, reviews[])`` as the source sends them.

    Ids travel as strings and the vote score as a string; a page holds the
    reviews of one product whose ids share ``id div 100`` (at most 100).
    """
    j = _joined(spark, sf_dir)
    review = F.struct(
        F.col("doc_id").cast("string").alias("recommendationid"),
        F.struct(F.col("user_id").cast("string").alias("steamid"),
                 F.col("user_id").alias("num_games_owned"),
                 (F.col("n_chars").cast("bigint") / 1000).cast("bigint").alias("num_reviews"),
                 F.floor(F.col("value") * 60).cast("bigint").alias("playtime_forever"),
                 F.lit(0).cast("bigint").alias("playtime_last_two_weeks"),
                 F.lit(None).cast("bigint").alias("playtime_at_review"),
                 unix_seconds_of("ts").alias("last_played")).alias("author"),
        F.col("lang").alias("language"),
        F.col("text").alias("review"),
        unix_seconds_of("ts").alias("timestamp_created"),
        unix_seconds_of("ts").alias("timestamp_updated"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("voted_up"),
        F.floor("value").cast("bigint").alias("votes_up"),
        F.get_json_object("props", "$.k").cast("bigint").alias("votes_funny"),
        F.round(F.col("value") / 500.0, 6).cast("string").alias("weighted_vote_score"),
        (F.col("n_chars") / 1000).cast("bigint").alias("comment_count"),
        (F.col("event_type") == "purchase").alias("steam_purchase"),
        (F.col("event_type") == "signup").alias("received_for_free"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("written_during_early_access"),
        F.when(F.col("event_type") == "error", F.lit(DEV_REPLY)).alias("developer_response"),
        F.lit(None).cast("bigint").alias("timestamp_dev_responded"),
    )
    return (j.withColumn("appid", F.regexp_extract("source", r"([0-9]+)$", 1))
            .groupBy(F.col("source").alias("title"), "appid",
                     (F.col("doc_id") / 100).cast("bigint").alias("page_no"))
            .agg(F.collect_list(review).alias("reviews"))
            .select("title", "appid", F.lit(1).alias("success"),
                    F.col("page_no").cast("string").alias("cursor"), "reviews"))


def event_deliveries(events: DataFrame) -> list[DataFrame]:
    """``events`` as ``EVENT_FILES`` deliveries in order of ``ts`` (rows without come first).

    Each also repeats the latest quarter of the time range of the one before.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(at.alias("at")).approxQuantile("at", [i / EVENT_FILES for i in range(EVENT_FILES + 1)], 0.01)
    cuts = cuts or [0.0] * (EVENT_FILES + 1)  # no row has a time
    out = [events.where(at.isNull() | (at <= F.lit(cuts[1])))]
    for before, low, high in zip(cuts, cuts[1:], cuts[2:]):
        part = events.where(at > F.lit(low - (low - before) / 4))
        out.append(part if len(out) == EVENT_FILES - 1 else part.where(at <= F.lit(high)))
    return out


def awkward_texts(reviews: DataFrame) -> DataFrame:
    """Seven of eight reviews get a text that a store may spoil: spaces and tabs at its ends, CRLF line
    breaks, no characters, NULL, quotes and commas, the store's own mark for NULL."""
    kinds = ["'  ' || review || '  '", r"review || '\t'", r"replace(review, '\n', '\r\n') || '\r\n'", "''",
             "CAST(NULL AS STRING)", """'"' || review || '","'""", r"'\\N'", "review"]
    cases = " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds))
    return reviews.withColumn("review", F.expr(f"CASE pmod(recommendation_id, 8) {cases} END"))

"""Explicit schemas (never inferred: ids arrive as strings, scores as string or number)."""

from pyspark.sql import types as T

AUTHOR = T.StructType([
    T.StructField("steamid", T.StringType()),
    T.StructField("num_games_owned", T.LongType()),
    T.StructField("num_reviews", T.LongType()),
    T.StructField("playtime_forever", T.LongType()),
    T.StructField("playtime_last_two_weeks", T.LongType()),
    T.StructField("playtime_at_review", T.LongType()),
    T.StructField("last_played", T.LongType()),
])

REVIEW = T.StructType([
    T.StructField("recommendationid", T.StringType()),
    T.StructField("author", AUTHOR),
    T.StructField("language", T.StringType()),
    T.StructField("review", T.StringType()),
    T.StructField("timestamp_created", T.LongType()),
    T.StructField("timestamp_updated", T.LongType()),
    T.StructField("voted_up", T.BooleanType()),
    T.StructField("votes_up", T.LongType()),
    T.StructField("votes_funny", T.LongType()),
    # string or bare number in the source; read as string, decoded later
    T.StructField("weighted_vote_score", T.StringType()),
    T.StructField("comment_count", T.LongType()),
    T.StructField("steam_purchase", T.BooleanType()),
    T.StructField("received_for_free", T.BooleanType()),
    T.StructField("written_during_early_access", T.BooleanType()),
    T.StructField("developer_response", T.StringType()),
    T.StructField("timestamp_dev_responded", T.LongType()),
])

QUERY_SUMMARY = T.StructType([
    T.StructField("num_reviews", T.IntegerType()),
    T.StructField("review_score", T.IntegerType()),
    T.StructField("review_score_desc", T.StringType()),
    T.StructField("total_positive", T.LongType()),
    T.StructField("total_negative", T.LongType()),
    T.StructField("total_reviews", T.LongType()),
])

ENVELOPE = T.StructType([
    T.StructField("success", T.IntegerType()),
    T.StructField("query_summary", QUERY_SUMMARY),
    T.StructField("reviews", T.ArrayType(REVIEW)),
    T.StructField("cursor", T.StringType()),
])

# Flat review table: 18 columns in this order (CSV header order).
FLAT_REVIEW = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("appid", T.StringType()),
    T.StructField("recommendation_id", T.LongType()),
    T.StructField("steam_id", T.LongType()),
    T.StructField("num_games_owned", T.LongType()),
    T.StructField("num_reviews", T.LongType()),
    T.StructField("playtime_forever", T.LongType()),
    T.StructField("language", T.StringType()),
    T.StructField("review", T.StringType()),
    T.StructField("timestamp_created", T.LongType()),
    T.StructField("voted_up", T.BooleanType()),
    T.StructField("votes_up", T.LongType()),
    T.StructField("votes_funny", T.LongType()),
    T.StructField("comment_count", T.LongType()),
    T.StructField("steam_purchase", T.BooleanType()),
    T.StructField("received_for_free", T.BooleanType()),
    T.StructField("written_during_early_access", T.BooleanType()),
    T.StructField("developer_response", T.StringType()),
])
FLAT_COLUMNS = [f.name for f in FLAT_REVIEW.fields]

# Sentiment table read by the text-analysis half.
SENTIMENT = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("user_review", T.StringType()),
    T.StructField("user_suggestion", T.IntegerType()),
    T.StructField("votes_up", T.LongType()),
    T.StructField("votes_funny", T.LongType()),
])

# Rewrite rules, one row per rule.
RULE = T.StructType([
    T.StructField("rule_order", T.IntegerType()),
    T.StructField("scope_title", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("literal", T.StringType()),
    T.StructField("replacement", T.StringType()),
])

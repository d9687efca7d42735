"""Review sources and sinks: page envelopes (JSON), stored review tables (CSV or Parquet)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.functions.constants import MISSING_TITLE
from revspark.operators.flatten import flatten_reviews
from revspark.schemas import ENVELOPE, FLAT_REVIEW, SENTIMENT
from revspark.session import path_exists, scratch_path
from revspark.sources import csvio
from revspark.sources.log import commit, committed_files, has_log, manifests


def read_review_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page envelopes (JSON lines, one response per line) with the explicit schema."""
    return spark.read.schema(ENVELOPE).json(path)


def read_flat_reviews(spark: SparkSession, path: str, title=None, appid=None) -> DataFrame:
    """Envelope files straight to the 18-column review table."""
    return flatten_reviews(read_review_pages(spark, path), title=title, appid=appid)


# Holds the text of a line with too few or too many fields.
CORRUPT = "_corrupt_line"
# A stored review without these is no review.
REQUIRED = ("recommendation_id", "timestamp_created", "voted_up")


def read_reviews(spark: SparkSession, path: str, strict: bool = False,
                 with_validity: bool = False, fmt: str = "csv") -> DataFrame:
    """Stored flat reviews, typed: the files a store's log names, or all files of a path without one.

    Texts come back as :func:`write_reviews` got them. A field with nothing between its commas,
    which other writers leave for an empty text, is the flat table's default: "NA" for title and
    product id, "" for other texts, NULL for the rest.

    Every CSV column is read as a string and cast with ``try_cast``; a row is valid
    when it has all fields, its required ones are present and every non-null source
    value converted. ``strict`` raises on an
    invalid row (the typed rows are stored first); otherwise invalid rows are dropped, or kept
    with ``is_valid`` when ``with_validity``. Stray header rows (from appending
    to a file that already had one) are invalid rows, never data.
    """
    files = committed_files(spark, path)
    if not files:  # every load so far was empty
        return spark.createDataFrame([], FLAT_REVIEW)
    if fmt != "csv":
        return spark.read.schema(FLAT_REVIEW).parquet(*files)
    raw = csvio.read_csv(spark, files, FLAT_REVIEW.fieldNames(), CORRUPT)
    defaults = {"title": MISSING_TITLE, "appid": MISSING_TITLE}
    cols, checks = [], []
    for f in FLAT_REVIEW.fields:
        src = F.col(f.name)
        if f.dataType.simpleString() == "string":
            absent = F.array_contains(csvio.ABSENT, f.name)
            cols.append(F.when(absent, F.lit(defaults.get(f.name, ""))).otherwise(src).alias(f.name))
            continue
        typed = F.lower(src).try_cast(f.dataType) if f.dataType.simpleString() == "boolean" \
            else src.try_cast(f.dataType)
        cols.append(typed.alias(f.name))
        checks.append(typed.isNotNull() if f.name in REQUIRED else src.isNull() | typed.isNotNull())
    ok = F.col(CORRUPT).isNull()
    for c in checks:
        ok = ok & c
    typed_df = raw.select(*cols, ok.alias("is_valid"))
    if strict:  # stored once: the check and whoever reads the rows do not parse the files again
        path = scratch_path(spark, "typed-reviews")
        typed_df.write.parquet(path)
        typed_df = spark.read.schema(typed_df.schema).parquet(path)
        bad = typed_df.filter(~F.col("is_valid")).limit(1).collect()
        if bad:
            raise ValueError(f"malformed review row: {bad[0].asDict()}")
    if with_validity:
        return typed_df
    return typed_df.filter("is_valid").drop("is_valid")


def read_sentiment_csv(spark: SparkSession, path: str) -> DataFrame:
    """The sentiment table (title, user_review, user_suggestion, votes_up, votes_funny).

    An empty text is "", a number that is none NULL; records with too few or too many fields go.
    """
    raw = csvio.read_csv(spark, path, SENTIMENT.fieldNames(), CORRUPT).where(F.col(CORRUPT).isNull())
    cols = []
    for f in SENTIMENT.fields:
        src = F.col(f.name)
        if f.dataType.simpleString() == "string":
            cols.append(F.when(F.array_contains(csvio.ABSENT, f.name), F.lit("")).otherwise(src).alias(f.name))
        else:
            cols.append(src.try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def write_reviews(df: DataFrame, path: str, mode: str = "new", fmt: str = "parquet", load: str | None = None) -> None:
    """Store flat review rows as one load of a store with a commit log.

    ``mode="new"`` refuses an existing store; ``mode="append"`` requires one (a
    resume never starts a fresh store by accident). Rows count once the load is
    published; a load repeated under its name ``load`` replaces itself. A store that a failed
    first load left without any published one counts as not existing. CSV gets a header in
    every part file; Parquet is the better store (typed, prunable).
    """
    spark = df.sparkSession
    exists = path_exists(spark, path) and committed_files(spark, path) != []
    started = exists and load is not None and load in manifests(spark, path)
    if mode == "new" and exists and not started:
        raise FileExistsError(path)
    if mode == "append" and not exists:
        raise FileNotFoundError(path)
    if exists and not has_log(spark, path):
        raise ValueError(f"{path} has no commit log; copy it to a new store first")
    rows = df.select(*[F.col(c).cast(FLAT_REVIEW[c].dataType) for c in FLAT_REVIEW.fieldNames()])

    def write(folder: str) -> None:
        if fmt == "csv":
            csvio.write_csv(rows, folder)
        else:
            rows.write.parquet(folder)
    commit(spark, path, load or uuid.uuid4().hex, write)

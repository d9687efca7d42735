"""Incremental collection with Structured Streaming.

* ``stream_review_pages``: page envelopes arriving as JSON files, read with the
  explicit envelope schema, at most ``max_files`` files per micro-batch (the
  bounded write buffer), flattened to review rows.
* ``dedupe_into_store``: ``foreachBatch`` that keeps only rows not yet stored
  (anti-join against the stored table) and writes each micro-batch to its own
  ``batch_id=<n>`` folder with overwrite, so a batch replayed after a failure
  replaces its own output instead of duplicating it. The store is the state:
  it never expires, exactly like the stored history it replaces.
* ``run_keyed_dedupe``: the same with the seen keys in a keyed state store instead of the stored
  table: a micro-batch looks up its own keys and reads nothing that was stored, so its
  cost does not grow with the history. The state never expires either.
* ``dedupe_within_watermark``: the bounded alternative (state kept only for the
  watermark delay); it also drops rows older than the watermark.
* ``score_stream``: fitted vectoriser + model applied to each micro-batch.
* ``incremental_load``: resume a stored load from new page files, with stop rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from revspark.operators.dedupe import ResumeInfo, drop_seen, resume_info, row_key
from revspark.operators.flatten import flatten_reviews
from revspark.operators.models import predict
from revspark.schemas import ENVELOPE
from revspark.session import path_exists

BATCH_DIR = "batch_id"


def stream_review_pages(spark: SparkSession, path: str, max_files: int = 1,
                        title=None, appid=None) -> DataFrame:
    """Streaming flat review rows from envelope JSON files under ``path``."""
    pages = (spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", max_files)
             .json(path))
    pages = pages.filter(F.size("reviews") > 0)  # an empty page ends nothing, adds nothing
    return flatten_reviews(pages, title=title, appid=appid)


@dataclass
class BatchLog:
    """New-row counts per micro-batch; ``exhausted`` once a batch adds nothing."""

    counts: dict = field(default_factory=dict)
    stopped: bool = False
    progress: list = field(default_factory=list)  # of a keyed dedupe, one report a micro-batch

    @property
    def exhausted(self) -> bool:
        return bool(self.counts) and list(self.counts.values())[-1] == 0


class StopLoad(Exception):
    """A stop rule holds: the batch at hand is left for a later run."""


def read_store(spark: SparkSession, store: str, schema) -> DataFrame:
    """Everything stored so far (empty frame before the first batch)."""
    if not path_exists(spark, store):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(store)


def dedupe_into_store(store: str, key_cols=None, order_col: str | None = None,
                      log: BatchLog | None = None, partition_col: str | None = None,
                      unique_order: bool = False, stop_when_exhausted: bool = False,
                      max_batches: int | None = None, earliest: bool = False):
    """``foreachBatch`` function: append only unseen rows of each micro-batch to ``store``.

    With ``partition_col`` (e.g. the creation day, which must be part of the
    key) the store is partitioned by it and a batch is compared only with the
    partitions its own rows fall in (NULL is a partition like any).

    ``earliest`` also stores a row whose key is stored with larger ``order_col`` only, so
    that the least of the stored rows of a key is its earliest, in whatever order files come.

    Stop rules: after a batch that added nothing (``stop_when_exhausted``), or after
    ``max_batches`` batches, the next batch is refused and stays uncommitted.
    """
    if partition_col is not None and key_cols is not None and partition_col not in key_cols:
        raise ValueError("partition_col must be one of key_cols")

    def run(batch: DataFrame, batch_id: int) -> None:
        if log is not None and ((stop_when_exhausted and log.exhausted)
                                or (max_batches is not None and len(log.counts) >= max_batches)):
            log.stopped = True
            raise StopLoad()
        spark = batch.sparkSession
        schema = StructType(batch.schema.fields + [StructField(BATCH_DIR, LongType())])
        hist = read_store(spark, store, schema)
        hist = hist.filter(F.col(BATCH_DIR) != batch_id)
        if partition_col is not None:
            own = batch.select(F.col(partition_col).alias("_own")).distinct()
            hist = hist.join(own, hist[partition_col].eqNullSafe(own["_own"]), "left_semi")
        new = drop_seen(batch, hist.drop(BATCH_DIR), key_cols=key_cols, order_col=order_col,
                        unique_order=unique_order, earliest=earliest)
        w = new.write.mode("overwrite")
        if partition_col is not None:
            w = w.partitionBy(partition_col)
        w.parquet(f"{store}/{BATCH_DIR}={batch_id}")
        if log is not None:
            # from the files' footers: an Observation would tie the session, which cannot be
            # serialised, to models that keep a training summary
            written = spark.read.schema(batch.schema).parquet(f"{store}/{BATCH_DIR}={batch_id}")
            log.counts[batch_id] = written.count()
    return run


def run_dedupe(stream: DataFrame, store: str, checkpoint: str, key_cols=None,
               order_col: str | None = None, available_now: bool = True,
               partition_col: str | None = None, **rules) -> BatchLog:
    """Drive ``stream`` into ``store`` until the input is exhausted or a stop rule of
    :func:`dedupe_into_store` holds; returns batch counts."""
    log = BatchLog()
    fn = dedupe_into_store(store, key_cols, order_col, log, partition_col, **rules)
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    q = writer.start()
    try:
        q.awaitTermination()
    except StreamingQueryException:
        if not log.stopped:
            raise
    return log


#: State on local disk with a change log in the checkpoint; the default provider holds it in memory.
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of_each_key(stream: DataFrame, key_cols, order_col: str | None = None) -> DataFrame:
    """Streaming rows that are, so far, the first of their key (update mode).

    Per key the state holds the row of the least ``order_col`` (NULL counts as largest), of those the
    earliest batch's, of those the least by content; without ``order_col`` the earliest batch's. A row
    passes when its batch makes it the first: the first time its key is seen, and again only
    when a later batch brings a smaller ``order_col``, so that the least of the rows passed is the
    earliest of all. Repeats of a key are combined before the shuffle, so no key is hot.
    """
    row = F.struct(*[F.col(c) for c in stream.columns])
    order = [F.col(order_col).isNull(), F.col(order_col)] if order_col else []
    rank = F.struct(*order, F.col("_arrived"), F.to_json(row))
    first = F.min_by(F.struct(F.col("_arrived").alias("arrived"), row.alias("row")), rank)
    return (stream.withColumn("_arrived", F.current_timestamp())  # one value a micro-batch, kept by its log
            .groupBy(row_key(key_cols).alias("_key")).agg(first.alias("_first"))
            .where(F.col("_first.arrived") == F.current_timestamp())
            .select(*[F.col(f"_first.row.`{c}`").alias(c) for c in stream.columns]))


def run_keyed_dedupe(stream: DataFrame, store: str, checkpoint: str, key_cols=None, order_col: str | None = None) -> BatchLog:
    """Drive ``stream`` into ``store`` until the input is exhausted, keeping :func:`first_of_each_key`.

    Each micro-batch has its own folder, replaced when it is replayed. The state starts empty: the
    checkpoint, not the store, knows the keys, so a store goes with one checkpoint.
    """
    spark, log = stream.sparkSession, BatchLog()

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/{BATCH_DIR}={batch_id}")
        written = spark.read.schema(batch.schema).parquet(f"{store}/{BATCH_DIR}={batch_id}")
        log.counts[batch_id] = written.count()  # from the files' footers

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_PROVIDER)
    try:
        query = (first_of_each_key(stream, list(key_cols or stream.columns), order_col).writeStream.outputMode("update")
                 .foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    log.progress = list(query.recentProgress)
    return log


def incremental_load(spark: SparkSession, pages: str, store: str, checkpoint: str, title=None, appid=None,
                     key_cols=None, max_files: int = 1, max_pages: int | None = None,
                     stop_when_exhausted: bool = True) -> tuple[ResumeInfo, BatchLog]:
    """Resume a stored load: read page files in order of arrival, store the reviews not stored yet.

    ``store`` may hold earlier loads, of one product only (else an error is raised before
    anything is read). Stops on a page file that adds nothing, or after ``max_pages``;
    page files not reached stay for the next run. Returns what was stored before
    (product, oldest review) and the new rows per page file.
    """
    rows = stream_review_pages(spark, pages, max_files, title, appid)
    before = ResumeInfo(None, None)
    if path_exists(spark, store):
        before = resume_info(spark.read.parquet(store))
    log = run_dedupe(rows, store, checkpoint, key_cols=key_cols, order_col="recommendation_id",
                     stop_when_exhausted=stop_when_exhausted, max_batches=max_pages)
    return before, log


def dedupe_within_watermark(stream: DataFrame, ts_col: str, key_cols, delay: str = "1 day") -> DataFrame:
    """Bounded-state streaming dedupe (event time must be a TIMESTAMP)."""
    return (stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
            .withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(list(key_cols)))


def score_stream(stream: DataFrame, vectorizer, model, store: str, checkpoint: str) -> None:
    """Score each micro-batch of new documents into ``store``: ``(doc_id, prediction)``.

    A replayed batch replaces its own folder.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        predict(model, vectorizer, batch).write.mode("overwrite").parquet(f"{store}/{BATCH_DIR}={batch_id}")

    (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())

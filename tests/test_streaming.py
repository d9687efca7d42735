"""Streaming dedupe (FIXTURES F15): a file delivered twice adds its rows once."""

import os
import shutil
import tempfile

from revspark.streaming import stream as SM

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_foreach_batch_dedupe(spark):
    src = tempfile.mkdtemp(prefix="revspark-src-")
    store = tempfile.mkdtemp(prefix="revspark-store-") + "/s"
    ck = tempfile.mkdtemp(prefix="revspark-ck-")
    shutil.copy(EVENTS, os.path.join(src, "a.parquet"))
    shutil.copy(EVENTS, os.path.join(src, "b.parquet"))
    schema = spark.read.parquet(EVENTS).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    log = SM.run_dedupe(stream.select("event_id", "user_id", "value"), store, ck,
                        key_cols=["event_id"])
    n = spark.read.parquet(EVENTS).count()
    assert list(log.counts.values()) == [n, 0]
    assert log.exhausted
    assert spark.read.parquet(store).count() == n


def test_watermark_dedupe(spark):
    src = tempfile.mkdtemp(prefix="revspark-src-")
    shutil.copy(EVENTS, os.path.join(src, "a.parquet"))
    shutil.copy(EVENTS, os.path.join(src, "b.parquet"))
    schema = spark.read.parquet(EVENTS).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = SM.dedupe_within_watermark(stream, "ts", ["event_id"], "1 day")
    q = (out.writeStream.format("memory").queryName("wm_dedupe").trigger(availableNow=True)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="revspark-ck-")).start())
    q.awaitTermination()
    assert spark.sql("SELECT * FROM wm_dedupe").count() == spark.read.parquet(EVENTS).count()


def test_foreach_batch_dedupe_partitioned(spark):
    from pyspark.sql import functions as F
    src = tempfile.mkdtemp(prefix="revspark-src-")
    store = tempfile.mkdtemp(prefix="revspark-store-") + "/s"
    ck = tempfile.mkdtemp(prefix="revspark-ck-")
    shutil.copy(EVENTS, os.path.join(src, "a.parquet"))
    shutil.copy(EVENTS, os.path.join(src, "b.parquet"))
    schema = spark.read.parquet(EVENTS).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
              .select("event_id", "user_id", F.to_date("ts").alias("day")))
    log = SM.run_dedupe(stream, store, ck, key_cols=["event_id", "day"], partition_col="day")
    n = spark.read.parquet(EVENTS).count()
    assert list(log.counts.values()) == [n, 0]
    assert spark.read.parquet(store).count() == n


def _folder(spark, batches, schema):
    """One Parquet file a batch, in order of modification."""
    src = tempfile.mkdtemp(prefix="revspark-src-")
    for i, rows in enumerate(batches):
        one = tempfile.mkdtemp(prefix="revspark-one-")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(one)
        part = next(f for f in os.listdir(one) if f.startswith("part-"))
        target = os.path.join(src, f"{i}.parquet")
        shutil.copy(os.path.join(one, part), target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return src


def _files(spark, batches, schema="event_id long, day string"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(_folder(spark, batches, schema))


def test_null_partition_value_is_stored_once(spark):
    stream = _files(spark, [[(1, None), (2, "a")], [(1, None), (3, "a")], [(1, None), (2, "a")]])
    store = tempfile.mkdtemp(prefix="revspark-store-") + "/s"
    log = SM.run_dedupe(stream, store, tempfile.mkdtemp(prefix="revspark-ck-"), key_cols=["event_id", "day"], partition_col="day")
    assert list(log.counts.values()) == [2, 1, 0]
    assert spark.read.parquet(store).count() == 3


def test_stop_rules_leave_the_rest_for_later(spark):
    batches = [[(1, "a")], [(1, "a")], [(2, "b")]]
    store, ck = tempfile.mkdtemp(prefix="revspark-store-") + "/s", tempfile.mkdtemp(prefix="revspark-ck-")
    stream = _files(spark, batches)
    log = SM.run_dedupe(stream, store, ck, key_cols=["event_id"], stop_when_exhausted=True)
    assert log.stopped and list(log.counts.values()) == [1, 0]
    assert spark.read.parquet(store).count() == 1
    log = SM.run_dedupe(stream, store, ck, key_cols=["event_id"])  # the refused file comes again
    assert not log.stopped and list(log.counts.values()) == [1]
    store, ck = tempfile.mkdtemp(prefix="revspark-store-") + "/s", tempfile.mkdtemp(prefix="revspark-ck-")
    log = SM.run_dedupe(_files(spark, batches), store, ck, key_cols=["event_id"], max_batches=1)
    assert log.stopped and list(log.counts.values()) == [1]


def test_replayed_batch_replaces_its_output(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, day string")
    store = tempfile.mkdtemp(prefix="revspark-store-") + "/s"
    write = SM.dedupe_into_store(store, ["event_id"])
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(store).count() == 2


def test_incremental_load_resumes(spark):
    import json
    from test_sources import REVIEW_A, _envelope
    pages, store = tempfile.mkdtemp(prefix="revspark-pages-"), tempfile.mkdtemp(prefix="revspark-store-") + "/s"
    ck = tempfile.mkdtemp(prefix="revspark-ck-")

    def page(name, ids, mtime):
        path = os.path.join(pages, name)
        with open(path, "w") as fh:
            fh.write(json.dumps(_envelope([dict(REVIEW_A, recommendationid=str(i), timestamp_created=1000 + i) for i in ids])) + "\n")
        os.utime(path, (mtime, mtime))

    page("0.json", [1, 2, 3], 1_700_000_000)
    before, log = SM.incremental_load(spark, pages, store, ck)
    assert before.oldest_created is None and list(log.counts.values()) == [3]
    page("1.json", [3, 4], 1_700_000_100)
    page("2.json", [1, 4], 1_700_000_200)
    page("3.json", [9], 1_700_000_300)
    before, log = SM.incremental_load(spark, pages, store, ck)
    assert before.oldest_created == 1001 and log.stopped and list(log.counts.values()) == [1, 0]
    assert sorted(r[0] for r in spark.read.parquet(store).select("recommendation_id").collect()) == [1, 2, 3, 4]


def test_score_stream(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.sql import functions as F
    from revspark.operators import models as MD
    docs = spark.createDataFrame([(i, "good fun" if i % 2 else "bad slow", i % 2) for i in range(20)], "doc_id long, text string, label int")
    vec = MD.fit_vectorizer(docs, 1, 1)
    model = LogisticRegression(regParam=0.01).fit(vec.transform(docs, [F.col("label").cast("double").alias("label")]))
    stream = _files(spark, [[(1, "good fun fun")], [(2, "slow slow bad")]], "doc_id long, text string")
    store = tempfile.mkdtemp(prefix="revspark-store-") + "/s"
    SM.score_stream(stream, vec, model, store, tempfile.mkdtemp(prefix="revspark-ck-"))
    got = spark.read.parquet(store)
    assert sorted((r.doc_id, r.prediction) for r in got.collect()) == [(1, 1), (2, 0)]
    truth = got.withColumn("label", F.when(F.col("doc_id") == 1, 1).otherwise(0))
    assert MD.accuracy(truth).first()[0] == 1.0


def _event_dir(spark, parts):
    """A data folder whose events table is a folder of ``parts`` files, the latest events first (0: one plain file)."""
    from pyspark.sql import functions as F
    sf = tempfile.mkdtemp(prefix="revspark-sf-")
    rows = [(i, i % 7, "view", float(i % 5)) for i in range(400)]
    df = (spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
          .withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("event_id") * 3600)))
    if parts:
        for k in reversed(range(parts)):
            df.where(F.floor(F.col("event_id") * parts / 400) == k).coalesce(1).write.mode("append").parquet(f"{sf}/events.parquet")
    else:
        df.coalesce(1).write.parquet(f"{sf}/whole")
        part = next(f for f in os.listdir(f"{sf}/whole") if f.startswith("part-"))
        shutil.copy(f"{sf}/whole/{part}", f"{sf}/events.parquet")
    return sf, rows


def test_event_streams_read_whole_tables_in_several_batches(spark, monkeypatch):
    from revspark.plans.catalog import QUERIES
    logs, run = [], SM.run_keyed_dedupe
    monkeypatch.setattr(SM, "run_keyed_dedupe", lambda *a, **k: logs.append(run(*a, **k)) or logs[-1])
    for parts in (5, 0):
        sf, rows = _event_dir(spark, parts)
        first = {}
        for i, *key in rows:
            first.setdefault(tuple(key), i)
        got = sorted(r[0] for r in QUERIES["stream_dedupe"](spark, sf).collect())
        assert got == sorted(first.values())
        assert len(logs[-1].counts) >= 4
        got = sorted(tuple(r) for r in QUERIES["watermark_dedupe"](spark, sf).collect())
        assert got == [(i, "view") for i in range(400)]


def test_deliveries_of_many_files_are_few_batches(spark, monkeypatch):
    """A large table's delivery is written by many tasks; a batch takes a delivery, not a file of it."""
    from revspark.plans import catalog as C
    logs, run, deliveries = [], SM.run_keyed_dedupe, C.ST.event_deliveries
    monkeypatch.setattr(SM, "run_keyed_dedupe", lambda *a, **k: logs.append(run(*a, **k)) or logs[-1])
    monkeypatch.setattr(C.ST, "event_deliveries", lambda events: [p.repartition(3) for p in deliveries(events)])
    sf, rows = _event_dir(spark, 0)
    first = {}
    for i, *key in rows:
        first.setdefault(tuple(key), i)
    assert sorted(r[0] for r in C.QUERIES["stream_dedupe"](spark, sf).collect()) == sorted(first.values())
    assert len(logs[-1].counts) == C.ST.EVENT_FILES


def test_event_deliveries_repeat_rows_and_lose_none(spark):
    from pyspark.sql import functions as F
    from revspark.plans import standins as ST
    df = spark.range(1000).select(F.col("id").alias("event_id"), F.when(F.col("id") > 9, F.timestamp_seconds("id")).alias("ts"))
    parts = [{r[0] for r in p.select("event_id").collect()} for p in ST.event_deliveries(df)]
    assert len(parts) == ST.EVENT_FILES and set.union(*parts) == set(range(1000))
    assert all(a & b for a, b in zip(parts, parts[1:])) and set(range(10)) <= parts[0]
    assert sum(p.count() for p in ST.event_deliveries(df.where("event_id < 5"))) == 5
    assert sum(p.count() for p in ST.event_deliveries(df.where("event_id < 0"))) == 0


def _keyed(spark, batches, key_cols, order_col, schema="id long, k string, v string"):
    src = _folder(spark, batches, schema)
    store, checkpoint = tempfile.mkdtemp(prefix="revspark-store-") + "/s", tempfile.mkdtemp(prefix="revspark-ck-")
    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    log = SM.run_keyed_dedupe(stream(), store, checkpoint, key_cols, order_col)
    return log, store, src, stream, checkpoint


def test_keyed_dedupe_equals_brute_force(spark):
    import random
    rng = random.Random(6)
    batches = [[(rng.choice([None, *range(200)]), rng.choice(["hot", "hot", None, *(f"k{i}" for i in range(30))]), rng.choice(["x", "y", None]))
                for _ in range(80)] for _ in range(5)]
    log, store, *_ = _keyed(spark, batches, ["k"], "id")
    big = 10 ** 9
    least, want = {}, []
    for rows in batches:
        now = {}
        for i, k, v in rows:
            now.setdefault(k, []).append(big if i is None else i)
        changed = {k: min(x) for k, x in now.items() if k not in least or min(x) < least[k]}
        least.update(changed)
        want.append(len(changed))
    assert list(log.counts.values()) == want
    got = {}
    for r in spark.read.parquet(store).collect():
        got.setdefault(r.k, []).append(big if r.id is None else r.id)
    assert {k: min(x) for k, x in got.items()} == least


def test_keyed_dedupe_reads_no_store_and_resumes(spark):
    rows = [(i, f"k{i}", "x") for i in range(50)]
    log, store, src, stream, checkpoint = _keyed(spark, [rows, rows, [(100, "k7", "y"), (101, "new", None)], rows], ["k"], None)
    assert list(log.counts.values()) == [50, 0, 1, 0]
    # a batch takes its own rows only, and looks its keys up in the state
    assert [p["numInputRows"] for p in log.progress if p["numInputRows"]] == [50, 50, 2, 50]
    state = [p["stateOperators"][0] for p in log.progress if p["numInputRows"]]
    assert [s["numRowsTotal"] for s in state] == [50, 50, 51, 51]
    assert not any(store in str(p["sources"]) for p in log.progress)
    # the same checkpoint goes on where it stopped
    spark.createDataFrame([(1, "k1", "again"), (2, "later", "z")], "id long, k string, v string").coalesce(1).write.mode("append").parquet(src)
    more = SM.run_keyed_dedupe(stream(), store, checkpoint, ["k"], None)
    assert list(more.counts.values()) == [1]
    assert spark.read.parquet(store).count() == 52


def test_keyed_dedupe_of_whole_rows(spark):
    rows = [(1, "a", None), (1, "a", None), (1, "a", "x"), (None, None, None), (None, None, None)]
    log, store, *_ = _keyed(spark, [rows, rows], None, None)
    assert list(log.counts.values()) == [3, 0] and spark.read.parquet(store).drop("batch_id").distinct().count() == 3


def test_stream_pages_deals_the_page_files_by_page(spark, monkeypatch):
    """One product has all reviews: its pages are in many files, which four micro-batches read."""
    from revspark.plans import catalog as C
    pages = spark.range(64).selectExpr(
        "'one' AS title", "'1' AS appid", "1 AS success", "cast(id AS string) AS cursor",
        "array(named_struct('recommendationid', cast(id AS string), 'author', named_struct('steamid', cast(id AS string)), 'language', 'english', 'review', 'text',"
        " 'timestamp_created', 86400 * (id % 3), 'voted_up', true)) AS reviews")
    monkeypatch.setattr(C.ST, "review_pages", lambda *a: pages)
    seen = {}
    from revspark.streaming import stream as SM
    real = SM.stream_review_pages

    def streamed(session, path, max_files=1, **kw):
        files = session.read.text(path).selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()
        seen["rows"], seen["max_files"] = sorted(r["count"] for r in files), max_files
        return real(session, path, max_files=max_files, **kw)

    monkeypatch.setattr(SM, "stream_review_pages", streamed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = C.QUERIES["stream_pages"](spark, "unused")
        assert out.count() == 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen["rows"]) == 8 and max(seen["rows"]) <= 24 and seen["max_files"] == 2

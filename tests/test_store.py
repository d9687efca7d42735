"""The review store: texts come back as they were, CSV splits inside quotes, loads count once."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from revspark.operators import dedupe as DD
from revspark.schemas import FLAT_REVIEW
from revspark.sources import csvio, log
from revspark.sources import reviews as RV

TEXTS = ["  lead and trail  ", "tab\t", " ", "", None, r"\N", r"\\N", "N", "a\r\nb", "a\nb", "\n", "\r", 'q"x"', '"', '""', '"\n', ",",
         'a,"b"\n",c', "é x", "x" * 5000 + "\n" * 3, "#c", "\\", '\\"', "NULL", "日本\n\n語", "null", "NA"]


def flat(spark, texts, first=0):
    row = {"title": "t", "appid": "1", "steam_id": 9, "num_games_owned": 1, "num_reviews": 1, "playtime_forever": 5,
           "language": "english", "timestamp_created": 7, "voted_up": True, "votes_up": 1, "votes_funny": None, "comment_count": 0,
           "steam_purchase": True, "received_for_free": False, "written_during_early_access": None}
    rows = [tuple({**row, "recommendation_id": first + i, "review": t, "developer_response": t}[n] for n in FLAT_REVIEW.fieldNames())
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, FLAT_REVIEW)


def path_of(name):
    return os.path.join(tempfile.mkdtemp(prefix="revspark-test-"), name)


def reviews_of(df):
    return sorted((r.recommendation_id, r.review, r.developer_response) for r in df.collect()) if df.columns else []


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_every_text_comes_back(spark, fmt):
    path = path_of("store")
    RV.write_reviews(flat(spark, TEXTS), path, fmt=fmt)
    back = RV.read_reviews(spark, path, strict=True, fmt=fmt)
    assert [f.dataType for f in back.schema] == [f.dataType for f in FLAT_REVIEW]
    assert {r.recommendation_id: (r.review, r.developer_response) for r in back.collect()} == {i: (t, t) for i, t in enumerate(TEXTS)}
    # a redelivery finds every stored review
    assert DD.drop_seen(flat(spark, TEXTS), back).count() == 0


def test_splits_inside_quotes(spark, small_splits):
    """One file in many tasks, most of which start inside a quoted text."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bc", ",", '"', "\n", '","', "\r\n", " ", 'x"y']) for _ in range(rng.choice([0, 3, 40, 400])))
             for _ in range(60)]
    path = path_of("store")
    csvio.write_csv(flat(spark, texts).coalesce(1), path)
    part = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert len(part) == 1
    lines = spark.read.option("lineSep", "\n").text(path)
    assert lines.rdd.getNumPartitions() > 50
    got = RV.read_reviews(spark, path, strict=True)
    assert {r.recommendation_id: r.review for r in got.collect()} == dict(enumerate(texts))
    # the same by one task that takes the whole file
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", csvio.NULL) \
        .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).csv(path)
    assert {int(r.recommendation_id): r.review for r in whole.collect()} == dict(enumerate(texts))


def test_many_splits_are_joined_by_shuffle(spark, small_splits, monkeypatch):
    monkeypatch.setattr(csvio, "BROADCAST_SPLITS", 0)
    texts = ["line\n" * n + '"' for n in range(40)]
    path = path_of("store")
    csvio.write_csv(flat(spark, texts).coalesce(1), path)
    assert {r.recommendation_id: r.review for r in RV.read_reviews(spark, path).collect()} == dict(enumerate(texts))


def test_records_of_other_writers(spark, small_splits):
    """Quotes only where needed, CRLF line ends, literal quotes in open fields, empty fields as defaults."""
    path = path_of("other.csv")
    names = FLAT_REVIEW.fieldNames()
    good = {n: "1" for n in names} | {"voted_up": "true", "steam_purchase": "true", "received_for_free": "false",
                                      "written_during_early_access": "false", "title": "", "language": "english", "developer_response": ""}
    def line(i, review):
        return ",".join((good | {"recommendation_id": str(i), "review": review})[n] for n in names)
    rows = [line(1, '5" disk'), line(2, '"say ""hi"",\r\nnow"'), line(3, ""), line(4, "plain"), line(5, '""'), line(6, '"a"b'), line(7, " sp ")]
    with open(path, "w", newline="") as fh:
        fh.write("\r\n".join([",".join(names), *rows]) + "\r\n")
    got = {r.recommendation_id: r for r in RV.read_reviews(spark, path, strict=True).collect()}
    assert {i: r.review for i, r in got.items()} == {1: '5" disk', 2: 'say "hi",\r\nnow', 3: "", 4: "plain", 5: "", 6: '"a"b', 7: " sp "}
    assert all(r.title == "NA" and r.developer_response == "" for r in got.values())


def test_ends_inside_follows_a_character_machine():
    def machine(line, inside):
        state, i = ("in" if inside else "start"), 0
        while i < len(line):
            c = line[i]
            if state == "start":
                state = "in" if c == '"' else "start" if c == "," else "open"
            elif state == "open":
                state = "start" if c == "," else "open"
            elif c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state = "open"
            i += 1
        return state == "in"
    rng = random.Random(3)
    for _ in range(20000):
        line = "".join(rng.choice('a,""') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            assert csvio.ends_inside(line, inside) == machine(line, inside), (line, inside)


def test_failed_append_is_invisible_and_its_retry_counts_once(spark):
    path = path_of("store")
    RV.write_reviews(flat(spark, ["a", "b"]), path, fmt="csv", load="one")
    more = flat(spark, ["c", "d", "e", "f"], first=10).repartition(4)
    broken = more.withColumn("review", F.when(F.col("review") == "e", F.raise_error(F.lit("lost"))).otherwise(F.col("review")))
    with pytest.raises(Exception, match="lost"):
        RV.write_reviews(broken, path, mode="append", fmt="csv", load="two")
    assert reviews_of(RV.read_reviews(spark, path)) == [(0, "a", "a"), (1, "b", "b")]
    for _ in range(3):  # the second and third run repeat a load that was published
        RV.write_reviews(more, path, mode="append", fmt="csv", load="two")
        assert [r[0] for r in reviews_of(RV.read_reviews(spark, path))] == [0, 1, 10, 11, 12, 13]
    assert set(log.manifests(spark, path)) == {"one", "two"}
    assert len([f for f in os.listdir(path) if f.startswith("load-two")]) <= 2  # the failed one, and the last


def test_load_written_but_not_published(spark, monkeypatch):
    """The driver dies after the part files are written, before the manifest is."""
    path = path_of("store")
    RV.write_reviews(flat(spark, ["a"]), path, load="one")
    listed = log._names
    def dies(spark, p):
        if "/load-two" in p:
            raise RuntimeError("driver lost")
        return listed(spark, p)
    monkeypatch.setattr(log, "_names", dies)
    with pytest.raises(RuntimeError):
        RV.write_reviews(flat(spark, ["b"], 5), path, mode="append", load="two")
    monkeypatch.setattr(log, "_names", listed)
    assert RV.read_reviews(spark, path, fmt="parquet").count() == 1
    RV.write_reviews(flat(spark, ["b"], 5), path, mode="append", load="two")
    assert sorted(r.review for r in RV.read_reviews(spark, path, fmt="parquet").collect()) == ["a", "b"]


def test_modes_and_empty_loads(spark):
    path = path_of("store")
    with pytest.raises(FileNotFoundError):
        RV.write_reviews(flat(spark, ["a"]), path, mode="append")
    RV.write_reviews(flat(spark, []), path, fmt="csv", load="none")
    assert RV.read_reviews(spark, path).count() == 0
    RV.write_reviews(flat(spark, ["a"]), path, mode="append", fmt="csv")
    with pytest.raises(FileExistsError):
        RV.write_reviews(flat(spark, ["a"]), path)
    with pytest.raises(ValueError):
        RV.write_reviews(flat(spark, ["a"]), path, mode="append", load="../x")
    assert RV.read_reviews(spark, path).count() == 1


def test_a_record_is_parsed_once(spark):
    path = path_of("parsed")
    RV.write_reviews(flat(spark, TEXTS), path, fmt="csv")
    plan = RV.read_reviews(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1

"""TF-IDF, vocabulary ids (FIXTURES F10)."""

import math

from pyspark.sql import functions as F

from revspark.operators import features as FE


def test_tfidf_f10(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    tok = lambda c: F.split(c, " ")
    w = FE.TfIdf(n_min=1, n_max=1, tokenizer=tok).fit_transform(docs)
    got = {(r.doc_id, r.term): round(r.weight, 6) for r in w.collect()}
    assert got == {(1, "a"): 0.942156, (1, "b"): 0.335176, (2, "b"): 0.579739, (2, "c"): 0.814802}


def test_tfidf_fit_on_train_ignores_unseen(spark):
    train = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    test = spark.createDataFrame([(3, "z y"), (4, "a z")], "doc_id long, text string")
    tok = lambda c: F.split(c, " ")
    model = FE.TfIdf(n_min=1, n_max=1, tokenizer=tok).fit(train)
    rows = model.transform(test).collect()
    assert [(r.doc_id, r.term, round(r.weight, 6)) for r in rows] == [(4, "a", 1.0)]


def test_alphabetical_ids(spark):
    words = [f"w{i:04d}" for i in range(0, 500, 7)]
    vocab = spark.createDataFrame([(w,) for w in reversed(words)], "term string")
    got = {r.term: r.id for r in FE.alphabetical_ids(vocab, num_partitions=5).collect()}
    assert got == {w: i + 1 for i, w in enumerate(sorted(words))}


def test_pad_model(spark):
    docs = spark.createDataFrame([(1, "zeta alpha beta"), (2, "beta")], "doc_id long, text string")
    model = FE.PadIds().fit(docs)
    assert model.pad_length == 3
    new = spark.createDataFrame([(3, "alpha unknown beta zeta alpha")], "doc_id long, text string")
    assert model.transform(new).first().ids == [2, 3, 1]
    assert [r.ids for r in model.transform(docs).orderBy("doc_id").collect()] == [[3, 1, 2], [0, 0, 2]]


def test_smooth_idf_formula(spark):
    v = spark.range(1).select(FE.smooth_idf(F.lit(1), F.lit(2)).alias("x")).first().x
    assert math.isclose(v, math.log(3 / 2) + 1)


def test_pad_ids_tokenizer_and_junk(spark):
    from pyspark.sql import functions as F

    from revspark.operators import features as FE
    docs = spark.createDataFrame([(1, "the red car!"), (2, "car car"), (3, "")], "doc_id long, text string")
    model = FE.PadIds().fit(docs)
    ids = {r.doc_id: r.ids for r in model.transform(docs).collect()}
    assert ids == {1: [2, 1], 2: [1, 1], 3: [0, 0]} or ids == {1: [2, 1][::-1], 2: [1, 1], 3: [0, 0]}
    model.pad_length = 4
    raw = {r.doc_id: r.ids for r in model.transform(docs, remove_junk=False).collect()}
    assert raw[1].count(0) == 2 and len(raw[1]) == 4  # "the" and "!" are unknown
    split = FE.PadIds(tokenizer=lambda c: F.split(F.lower(c), "a")).fit(docs)
    assert split.vocab.count() >= 3


def test_tfidf_moves_the_pairs_once_by_term_and_once_back(spark):
    """Texts go to their document's task, so counting needs no exchange of its own; ids may repeat."""
    docs = spark.createDataFrame([(1, "red car"), (1, "red bus"), (2, "car car"), (3, "")], "doc_id long, text string")
    out = FE.TfIdf(n_min=1, n_max=1).fit_transform(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    by = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert sorted(by) == ["doc_id", "doc_id", "term"]
    idf = {t: math.log((1 + 4) / (1 + n)) + 1 for t, n in (("red", 1), ("bus", 1), ("car", 2))}
    one = {"red": 2 * idf["red"], "car": idf["car"], "bus": idf["bus"]}
    norm = math.sqrt(sum(w * w for w in one.values()))
    want = {(1, t): round(w / norm, 9) for t, w in one.items()} | {(2, "car"): 1.0}
    assert {(r.doc_id, r.term): round(r.weight, 9) for r in out.collect()} == want


def test_tfidf_min_df_and_most_frequent_features(spark):
    docs = spark.createDataFrame([(1, "red car"), (2, "car bus bus"), (3, "red car")], "doc_id long, text string")
    some = FE.TfIdf(n_min=1, n_max=1, min_df=2).fit_transform(docs)
    assert {(r.doc_id, r.term) for r in some.collect()} == {(1, "red"), (1, "car"), (2, "car"), (3, "red"), (3, "car")}
    top = FE.TfIdf(n_min=1, n_max=1, max_features=1).fit_transform(docs)
    assert {(r.doc_id, r.term, r.weight) for r in top.collect()} == {(1, "car", 1.0), (2, "car", 1.0), (3, "car", 1.0)}

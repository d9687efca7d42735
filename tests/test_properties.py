"""Property tests: padding, n-grams, split sizes (each example batch is one DataFrame)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revspark.functions import text as TX
from revspark.operators import features as FE
from revspark.operators import split as SP

SETTINGS = settings(max_examples=15, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.lists(st.integers(1, 99), max_size=12), min_size=1, max_size=20),
       st.integers(1, 8))
def test_pad_ids_length_and_suffix(spark, arrays, length):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    got = {r.i: r.p for r in df.select("i", FE.pad_ids("a", length).alias("p")).collect()}
    for i, a in enumerate(arrays):
        p = got[i]
        assert len(p) == length
        keep = a[-length:]
        assert p[length - len(keep):] == keep
        assert all(x == 0 for x in p[:length - len(keep)])


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=9), min_size=1,
                max_size=20))
def test_ngrams_match_python(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t array<string>")
    got = {r.i: sorted(r.g) for r in df.select("i", TX.ngrams("t", 1, 3).alias("g")).collect()}
    for i, d in enumerate(docs):
        expect = [" ".join(d[j:j + n]) for n in (1, 2, 3) for j in range(len(d) - n + 1)]
        assert got[i] == sorted(expect)


@SETTINGS
@given(st.lists(st.integers(0, 3), min_size=1, max_size=300), st.sampled_from([0.1, 0.25, 0.5]))
def test_split_sizes(spark, labels, frac):
    df = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "id long, label int")
    rows = SP.stratified_split(df, "label", "id", frac).collect()
    assert sorted(r.id for r in rows) == list(range(len(labels)))
    for lab in set(labels):
        n = labels.count(lab)
        assert sum(1 for r in rows if r.label == lab and r.is_test) == math.ceil(frac * n)


def test_keep_filter_regex_matches_definition(spark):
    text = "A b-c d_e ¿x? $y 2€ ﬁne Ǆ ǅ x́ kK"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(TX.filtered_tokens("t").alias("a"),
                  F.filter(TX.tokenize(F.lower("t")), lambda x: TX.keep_token(x)).alias("b")).first()
    assert r.a == r.b

"""Scalar and array expressions (FIXTURES F9)."""

from pyspark.sql import functions as F

from revspark.functions import constants as K
from revspark.functions import decode as DC
from revspark.functions import text as TX
from revspark.operators.features import pad_ids


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_stop_words_equal_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert K.STOP_WORDS_EN == StopWordsRemover.loadDefaultStopWords("english")


def test_pad_ids_front(spark):
    assert one(spark, pad_ids(F.array(*[F.lit(i) for i in [1, 2, 3, 4, 5]]), 3)) == [3, 4, 5]
    assert one(spark, pad_ids(F.array(F.lit(7)), 3)) == [0, 0, 7]
    assert one(spark, pad_ids(F.array().cast("array<int>"), 2)) == [0, 0]


def test_ngrams_guard(spark):
    arr = F.array(F.lit("a"), F.lit("b"))
    assert sorted(one(spark, TX.ngrams(arr, 1, 3))) == ["a", "a b", "b"]
    assert one(spark, TX.ngrams(F.array(F.lit("a")), 2, 3)) == []


def test_keep_token(spark):
    toks = [":", "the", "café", "game", "$"]
    got = [one(spark, TX.keep_token(F.lit(t))) for t in toks]
    assert got == [False, False, False, True, True]
    assert one(spark, TX.keep_token(F.lit(":"), F.lit(True))) is True
    assert one(spark, TX.keep_token(F.lit("the"), stop=False)) is True


def test_masked_words_and_emoticons(spark):
    assert one(spark, TX.collapse_masked(F.lit("a **** $$$$ ♥♥♥♥♥ *** "), "X")) == "a X X X *** "
    assert one(spark, TX.normalize_emoticons(F.lit("ok :) bad :-( =D"))) == "ok smile bad sad smile"


def test_decoders(spark):
    assert one(spark, DC.to_double_or_zero(F.lit("0.56"))) == 0.56
    assert one(spark, DC.to_double_or_zero(F.lit(0))) == 0.0
    assert one(spark, DC.to_double_or_zero(F.lit("x"))) == 0.0
    assert one(spark, DC.to_id(F.lit("18446744073709551615"))) is None
    assert str(one(spark, DC.to_u64(F.lit("18446744073709551615")))) == "18446744073709551615"
    assert one(spark, DC.to_u64(F.lit("18446744073709551616"))) is None
    assert one(spark, DC.int_to_bool(F.lit(2))) is False
    ts = one(spark, F.date_format(DC.unix_to_timestamp(F.lit(1618826641)), "yyyy-MM-dd HH:mm:ss"))
    assert ts == "2021-04-19 10:04:01"


def test_days_since(spark):
    t = 1_000_000
    assert one(spark, DC.days_since(F.lit(t), t + 86399)) == 0
    assert one(spark, DC.days_since(F.lit(t), t + 86400)) == 1
    assert one(spark, DC.days_since(F.lit(t), t - 43200)) == 0
    import pytest
    with pytest.raises(Exception):
        one(spark, DC.days_since(F.lit(t), t - 86400))


def test_language_parse(spark):
    assert one(spark, DC.normalize_language(F.lit("Français"))) == "french"
    assert one(spark, DC.normalize_language(F.lit("fl"))) == "finnish"
    assert one(spark, DC.normalize_language(F.lit("fi"))) == "finnish"
    assert one(spark, DC.normalize_language(F.lit("vn"))) == "vietnamese"
    assert one(spark, DC.normalize_language(F.lit("klingon"))) is None
    assert one(spark, DC.normalize_language(F.lit("All"))) is None
    assert DC.language_dim(spark).count() == 30


def test_score_ordinal(spark):
    for i, lab in enumerate(K.SCORE_LABELS, start=1):
        assert one(spark, DC.review_score_ordinal(F.lit(lab))) == i
        assert one(spark, DC.review_score_label(F.lit(i))) == lab
    assert one(spark, DC.review_score_ordinal(F.lit("Great"))) is None


def test_element_text(spark):
    html = '<div class="x">no</div><div id="a" class="ad">A &amp; <b>B</b></div><div class="ad">2</div>'
    assert one(spark, TX.element_text(F.lit(html), "ad")) == "A & B"
    assert one(spark, TX.element_text(F.lit("<p>none</p>"), "ad")) == "NA"


def test_filtered_tokens_equals_keep_filter(spark):
    texts = ["Hello, WORLD! $5 + x=y ~ a|b ^c `d` <e>", "İstanbul Kelvin café naïve 3rd x\x01y",
             "the and of_it don't it's ß ẞ ½ ٣4 ¿que? ¡si!", "", "tab\tnew\nline\x0bvt\x1cfs"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fast = TX.filtered_tokens("t")
    slow = F.filter(TX.tokenize(F.lower("t")), lambda x: TX.keep_token(x))
    for r in df.select(fast.alias("a"), slow.alias("b")).collect():
        assert r.a == r.b


def test_unix_seconds_ignore_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        v = one(spark, DC.unix_seconds_of(F.lit("2021-04-19 10:04:01.75").cast("timestamp_ntz")))
        assert v == 1618826641
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_element_text_follows_the_selector():
    from revspark.functions.text import first_element_text as f
    assert f('<div class="ad">A<div>B</div>C</div><div class="ad">no</div>', "div", "ad") == "ABC"
    assert f('<!-- <div class="ad">no</div> --><div class="ad">yes</div>', "div", "ad") == "yes"
    assert f('<div data-class="ad">no</div><p class="ad">no</p>', "div", "ad") is None
    assert f("<div class='x ad'> yes </div>", "div", "ad") == "yes"
    assert f('<div class="ad">&trade; &#233; &amp;lt;</div>', "div", "ad") == "\u2122 \u00e9 &lt;"
    assert f('<div class="bad">no</div>', "div", "ad") is None and f(None, "div", "ad") is None

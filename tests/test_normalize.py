"""Ordered rewrite rules against a brute-force Python ``re`` fold."""

import re

import pytest

from revspark.operators import normalize as NZ

TEXTS = [
    ("call of duty", "I dont like FPS games in VR, ww2 is fine. mmorpg lol :) ur pc is slow"),
    ("everquest", "EQ raids with npc friends. It's a MOBA? no, an rpg! ★★★☆ didn't matter"),
    ("other", "Théâtre évr VR; 60fps tl;dr youre free-to-play f2p P2W xbox one x-box lol LOOOL"),
    ("call of duty", "WW ww Ww; he'd say thats whats up; 'em gotta asap ♥ <3 i'm done 1st 2nd"),
    ("misc", ""),
]


def brute(title, text, rules):
    for r in rules:
        if r.scope_title and not re.search(r.scope_title, title, flags=re.I):
            continue
        text = re.sub(r.pattern, r.replacement, text, flags=re.I)
    return text


def test_shipped_rules_match_python_re(spark):
    rules = NZ.load_rules(on_bad_rule="skip")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, p struct<title:string,text:string>")
    df = df.selectExpr("i", "p.title AS title", "p.text AS text")
    got = {r.i: r.text for r in NZ.apply_rules(df, rules, "text", title_col="title").collect()}
    for i, (title, text) in enumerate(TEXTS):
        assert got[i] == brute(title, text, rules), (i, got[i])


def test_invalid_rules():
    with pytest.raises(ValueError):
        NZ.load_rules(on_bad_rule="error")
    lit = NZ.load_rules(on_bad_rule="literal")
    skip = NZ.load_rules(on_bad_rule="skip")
    assert len(lit) == len(skip) + 6


def test_required_literals():
    assert NZ.required_literals("(?<![\\w])fps(?![\\w])") == ("fps",)
    assert NZ.required_literals("f2p|free-to-play") == ("f2p", "free-to-play")
    assert NZ.required_literals("ps(x|1|2)") == ("ps",)
    assert NZ.required_literals("lo*l") == ("l",)
    assert NZ.required_literals("[#%&]{3}") == ()
    assert NZ.required_literals("(ou){2,}") == ()


def test_word_match_unicode(spark):
    from pyspark.sql import functions as F
    rule = NZ.Rule(0, "vr", "virtual reality", match="word", literal="vr")
    out = spark.range(1).select(NZ.rule_step(F.lit("VR évr vr."), rule).alias("x")).first().x
    assert out == "virtual reality évr virtual reality."


def test_letters_that_fold_to_ascii_fire_rules_and_texts_are_not_scanned_for_all(spark):
    rules = [NZ.Rule(0, "moba", "arena", literal="moba"), NZ.Rule(1, "kiss", "hug", literal="kiss"), NZ.Rule(2, "hug", "end", literal="hug")]
    texts = ["MOBA", "Kİſs", "kıss kiss", "nothing", None]
    out = NZ.apply_rules(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), rules, "text")
    assert [r.text for r in out.orderBy("id").collect()] == ["arena", "end", "end end", "nothing", None]
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()

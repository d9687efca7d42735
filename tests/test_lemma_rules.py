"""Suffix rules for unseen forms."""

from revspark.operators import lemma_rules as LR

PAIRS = [("stories", "story"), ("parties", "party"), ("cities", "city"), ("walked", "walk"), ("talked", "talk"), ("jumped", "jump"),
         ("dogs", "dog"), ("cats", "cat"), ("games", "game"), ("bodies", "body"), ("running", "run"), ("sitting", "sit"), ("planning", "plan"),
         ("went", "go"), ("dogs", "dog")]


def brute_force(pairs, forms, least=2):
    from collections import Counter
    counts = Counter()
    for form, lemma in set(pairs):
        keep = 0
        while keep < min(len(form), len(lemma)) and form[keep] == lemma[keep]:
            keep += 1
        cut, added = len(form) - keep, lemma[keep:]
        for n in range(cut, min(len(form) - 1, 5) + 1):
            counts[form[len(form) - n:], cut, added] += 1
    rules = {}
    for (suffix, cut, added), n in counts.items():
        if n >= least:
            rules[suffix] = min(rules.get(suffix, (0, 0, "")), (-n, cut, added))
    out = {}
    for f in forms:
        out[f] = f
        for n in range(min(len(f) - 1, 5), -1, -1):
            if f[len(f) - n:] in rules:
                _, cut, added = rules[f[len(f) - n:]]
                out[f] = f[:len(f) - cut] + added
                break
    return out


def test_equals_brute_force_and_generalises(spark):
    pairs = spark.createDataFrame(PAIRS + [(None, "x"), ("x", None), ("", "")], "form string, lemma string")
    forms = ["berries", "looked", "birds", "spinning", "walk", "ant", "", "s", "ponies", "été", "ies"]
    rules = LR.learn_suffix_rules(pairs)
    got = {r.form: r.lemma for r in LR.apply_suffix_rules(
        spark.createDataFrame([(f,) for f in forms + ["birds", None]], "form string"), rules).collect()}
    want = brute_force(PAIRS + [("", "")], forms)
    assert got == want
    assert got["berries"] == "berry" and got["looked"] == "look" and got["birds"] == "bird" and got["ponies"] == "pony" and got["ant"] == "ant"


def test_known_lemmas_come_first_and_empty_tables(spark):
    pairs = spark.createDataFrame(PAIRS, "form string, lemma string")
    tokens = spark.createDataFrame([("Went",), ("dogs",), ("cups",), (None,)], "token string")
    rules = LR.learn_suffix_rules(pairs)
    got = {r.form: r.lemma for r in LR.lemmas_for(tokens, pairs, rules).collect()}
    assert got["went"] == "go" and got["dogs"] == "dog" and got["cups"] == "cup"
    none = LR.learn_suffix_rules(pairs.limit(0))
    assert none.count() == 0
    assert {r.lemma for r in LR.apply_suffix_rules(tokens.selectExpr("token AS form"), none).collect()} == {"Went", "dogs", "cups"}


def test_pairs_of_a_vocabulary(spark):
    words = spark.createDataFrame([(w,) for w in ["walk", "walks", "walked", "walkes", "as", "a", "bus", "walkess", "walkes"]], "term string")
    got = {(r.form, r.lemma) for r in LR.pairs_of_vocabulary(words, ("s", "es", "ed")).collect()}
    assert got == {("walks", "walk"), ("walked", "walk"), ("walkes", "walk"), ("walkess", "walkes")}

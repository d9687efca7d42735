import random
import re

import pytest

from helpers import awkward, documents, sentence
from revspark.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_and_trie_equal_brute_force():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 10))): rng.random() + .1 for _ in range(60)}
    trie = T.Trie()
    for t, w in terms.items():
        trie.put(t, w)
    for _ in range(400):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11)))
        near = [(distance(word, t), -w) for t, w in terms.items()]
        fits = [(d, w) for (d, w), t in zip(near, terms)
                if d == 0 or d <= min(T.allowed_edits(len(word)), T.allowed_edits(len(t)))]
        want = min(fits, default=None)
        got = T.nearest_term(trie, word)
        assert (got is None) == (want is None)
        if got:
            assert (got[1], -got[0]) == want


def test_stems_match_any_ending():
    trie = T.Trie()
    trie.put("vequ", 2.0, stem=True)
    assert T.nearest_term(trie, "vequeur") == (2.0, 0) and T.nearest_term(trie, "veq") is None


def test_context_lowers_quotation_and_raises_address():
    scan = T.Scanner(T.Lexicon({"blockhead": 3.0}))
    plain, said = scan("what a blockhead here")[0][1], scan('they said "blockhead" here')[0][1]
    marks, you = scan('a "blockhead" here')[0][1], scan("you are a blockhead here")[0][1]
    assert said < marks < plain < you
    assert scan("such a blokhead here")[0][1] == pytest.approx(plain * T.EDIT)
    assert scan("nothing of that kind")[0] == [0.0, 0.0, 0.0]


def corpus(spark, n=600, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = sentence(rng, rng.randint(20, 60)).split()
        if toxic:
            for t in rng.sample(["grumblor", "snarfing", "blockhead", "vexoid"], 2):
                w.insert(rng.randrange(len(w)), t)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_terms_and_scores_held_out_rows(spark):
    rows, labels = corpus(spark)
    rows += [(5000, "some words then grumblar and vexoid come", "s"), (5001, None, "s"), (5002, "", "s"), (None, "null id", None)]
    df = documents(spark, rows)
    model = T.train(df, labels)
    assert set(model.lexicon.terms) == {"grumblor", "snarfing", "blockhead", "vexoid"}
    got = {r["row"]["doc_id"]: r["score"] for r in T.score(df, model, keep=["doc_id"]).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all((got[i] >= .5) == bool(y) for i, y in truth.items())
    assert got[5000] >= .5 and got[5001] == got[5002] < .5 and len(got) == len(rows)
    kept = T.reject_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == len(rows) - sum(truth.values()) - 1


def misspelled(rng, word, at):
    """One random edit at a letter of ``at``."""
    i, letters = rng.choice(at), "abcdefghijklmnopqrstuvwxyz"
    return rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice(letters) + word[i:],
                       word[:i] + rng.choice(letters.replace(word[i], "")) + word[i + 1:]])


def test_stems_made_by_misspellings_leave_the_term_its_edits(spark):
    rng = random.Random(8)
    term, rows, labels = "worthless", [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = sentence(rng, rng.randint(20, 60)).split()
        if toxic:
            w.insert(rng.randrange(len(w)), misspelled(rng, term, range(len(term))) if rng.random() < .3 else term)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(documents(spark, rows), labels)
    assert any(term.startswith(s) for s in model.lexicon.stems)  # what the misspellings bring about
    assert term in model.lexicon.terms
    scan = T.Scanner(model.lexicon)
    early = {misspelled(rng, term, range(4)) for _ in range(200)}
    assert not [w for w in early if not scan.look_up(w)]
    assert T.nearest_term(scan.trie, "w0rthless")[1] == 1


def test_copies_do_not_make_terms(spark):
    rows, labels = corpus(spark, 300)
    copied = "only here zanzibar quokka " * 3
    rows += [(10_000 + i, copied, "s") for i in range(100)]
    labels = labels.union(spark.createDataFrame([(10_000 + i, 1) for i in range(100)], "doc_id long, toxic int"))
    assert not {"zanzibar", "quokka"} & set(T.train(documents(spark, rows), labels).lexicon.terms)


def test_sample_holds_one_row_of_an_id(spark):
    rows = [(7, f"text {i} of one id", "s") for i in range(50)] * 2 + [(8, None, "s"), (9, "other", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int").where("doc_id IN (7, 8, 9)")
    labels = labels.where(~T.held_out())
    got = T.labelled_sample(documents(spark, rows), labels, "toxic")
    again = T.labelled_sample(documents(spark, rows[::-1]), labels, "toxic")
    assert got.columns == ["text", "y"]
    assert got.count() == labels.count() > 1
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_awkward_rows_and_no_labels(spark):
    df = documents(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = T.score(df, T.train(df, none), keep=["doc_id"]).collect()
    assert len(out) == df.count() and all(r["score"] < 0.5 for r in out)
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    assert T.reject_toxic(df, nulls).count() == df.count()
    empty = documents(spark, [])
    assert T.reject_toxic(empty, none).count() == 0


def test_quotations_equal_the_patterns_without_their_bound():
    pattern = re.compile(r'"[^"\n]+"|“[^”\n]+”|«[^»\n]+»|„[^“”\n]+[“”]')
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice('ab "“”«»„\n') for _ in range(rng.randint(0, 25)))
        assert T.quotations(text) == [m.span() for m in pattern.finditer(text)], text
    long = '"' + "word " * 500 + '"'
    assert T.quotations(long) == [(0, len(long))]


def test_long_texts_of_quotations_take_time_in_proportion():
    import time
    scanner = T.Scanner(T.Lexicon({"worthless": 1.0}))
    for text in ('"worthless" ' * 80000, "« " * 500000 + "worthless", "„worthless" * 80000, '""' * 500000 + "worthless"):
        began = time.process_time()
        scanner(text)
        assert time.process_time() - began < 5, text[:20]

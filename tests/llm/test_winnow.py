"""Benchmark decontamination against a plain search of every window."""

import hashlib
import random
import re

import numpy as np
import pytest

from helpers import documents, sentence

from revspark.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_force(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words_of(t)
        span = min(window, len(w))
        for p in range(len(w) - span + 1 if w else 0):
            windows.setdefault(tuple(w[p:p + span]), set()).add("" if i is None else str(i))
    spans = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for span in spans:
            for p in range(len(w) - span + 1):
                who = windows.get(tuple(w[p:p + span]))
                if who:
                    hit |= set(range(p, p + span))
                    found |= who
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    df = documents(spark, [(d, t, "s") for d, t in docs]).selectExpr("*", "1 AS doc", "2 AS digest", "3 AS words", "4 AS item", "5 AS n_hit")
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS window", "2 AS gram", "3 AS doc_id")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in winnow.decontaminate(df, it, **kw).collect()), key=repr)


def fixture(seed):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.randint(10, 60), 40)) for i in range(12)]
    items += [(20, "Just Three Words"), (21, "one"), (22, ""), (23, None), (24, "a b c d e f"), (25, items[0][1]), (0, "a second row of item zero has these eleven words in it"),
              (None, "the item without an id still has ten words here"), (26, "x x x x x x x x x x x x")]
    docs = []
    for i in range(80):
        text = sentence(rng, rng.randint(0, 200), 40).split()
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(w))
            at = rng.randint(0, len(text))
            text[at:at] = w[a:a + rng.choice([8, 9, 10, 11, 30])]
        docs.append((i, rng.choice([" ", "\n", ", ", "--"]).join(text).upper() if i % 3 else " ".join(text)))
    docs += [(100, None), (101, ""), (102, " ?! "), (103, docs[5][1]), (103, docs[5][1]), (None, docs[6][1]), (104, "x " * 500),
             (105, sentence(rng, 20000, 40) + " " + items[1][1]), (106, "été " * 9 + items[2][1]), (107, "one")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search_of_every_window(spark, seed):
    docs, items = fixture(seed)
    found = run(spark, docs, items)
    assert found == brute_force(docs, items)
    assert sum(1 for x in found if x[2]) > 20 and any(not x[2] for x in found)


def test_shuffled_when_items_are_many(spark, monkeypatch):
    from revspark.llm import common
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(winnow, "sized_broadcast", lambda df: common.sized_broadcast(df, 0))
    docs, items = fixture(3)
    assert run(spark, docs, items, window=7) == brute_force(docs, items, 7)


def test_empty_tables(spark):
    docs, items = fixture(4)
    assert run(spark, docs[:5], items[10:10] + [(1, None)]) == brute_force(docs[:5], [])
    df = documents(spark, [(1, "a", "s")])
    assert winnow.decontaminate(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_equal_spans_keep_a_common_gram():
    """Whatever stands around a shared span of ``window`` words, both sides keep one gram of it."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        shared = rng.integers(0, 3, 10).astype(np.uint64)
        kept = []
        for _ in range(2):
            a, b = rng.integers(0, 3, rng.integers(0, 20)), rng.integers(0, 3, rng.integers(0, 20))
            text = np.concatenate([a, shared, b]).astype(np.uint64)
            at, g = winnow.winnowed(winnow.mix(text), np.zeros(len(text), np.int64), 5, 10)
            kept.append({int(h) for p, h in zip(at, g) if len(a) <= p <= len(a) + 5})
        assert kept[0] & kept[1]


def test_digest_columns(spark):
    from revspark.llm.queries import QUERIES
    rows = QUERIES["op12_decontamination"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.contaminated for r in rows)
    assert all(r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.n_items == 0)

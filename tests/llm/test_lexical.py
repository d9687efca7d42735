"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from helpers import documents, sentence

from revspark.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_force(docs, items, k):
    docs = [(d, Counter(terms_of(t))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms_of(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        scored.sort()
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, k):
    df = documents(spark, [(d, t, "s") for d, t in docs]).selectExpr("*", "1 AS doc", "2 AS item_id", "3 AS terms", "4 AS ids")
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS term", "3 AS doc_id", "4 AS query")
    return sorted((tuple(r) for r in lexical.search(df, it, k).collect()), key=repr)


def fixture(seed):
    rng = random.Random(seed)

    def text(n):  # common and rare words
        return " ".join(f"W{int(rng.paretovariate(0.6))}" if rng.random() < 0.6 else rng.choice("abcdef") for _ in range(n))

    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "?!"), (403, docs[3][1]), (403, docs[3][1]), (None, docs[4][1]), (None, docs[3][1]),
             (404, sentence(rng, 20000)), (405, "été É 日本 日本")]
    items = [(i, text(rng.randint(1, 40))) for i in range(15)] + [(20, ""), (21, None), (22, "nowhere-to-be-found"), (None, "a b W1"),
                                                                 (0, "W1 W2 W2"), (23, "a " * 50), (24, "ÉTÉ 日本 été"), (25, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("seed,k", [(1, 20), (2, 3)])
def test_equals_scoring_every_document(spark, seed, k):
    docs, items = fixture(seed)
    assert run(spark, docs, items, k) == brute_force(docs, items, k)


def test_rounds_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_PAIRS", 40)
    docs, items = fixture(3)
    assert run(spark, docs, items, 5) == brute_force(docs, items, 5)


def test_empty_tables(spark):
    docs, items = fixture(4)
    it = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, [(i, t, "s") for i, t in docs])
    assert lexical.search(df.limit(0), it).count() == 0
    assert lexical.search(df, it.limit(0)).count() == 0
    assert lexical.search(df, it.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("short,size", [(0.0, 2048), (0.02, 8), (0.3, 64), (1.0, 16)])
def test_every_split_and_range_gives_the_same(monkeypatch, short, size):
    """In one block, without Spark: ranges are skipped, results stay."""
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(lexical, "RANGE", size)
    docs, items = fixture(5)
    texts = [t for _, t in docs]
    wanted = sorted({t for _, x in items for t in terms_of(x)})
    batch = pa.RecordBatch.from_pydict({"doc": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array(texts, pa.string())})
    block = next(lexical._index(wanted)([batch]))
    n_docs, total = block.column("docs")[0].as_py(), block.column("terms")[0].as_py()
    df = {x["term"]: x["df"] for x in block.column("held")[0].as_py()}
    lists = lexical._Lists(block.column("body")[0].as_py(), n_docs, total)
    ids = np.array([d or 0 for d, _ in docs])
    null = np.array([d is None for d, _ in docs])
    got = []
    for i, text in items[:15]:
        count = Counter(wanted.index(t) for t in terms_of(text))
        asked = [(t, n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t, n in count.items() if t in df]
        best = lexical._Best(4, 1)
        lexical._search(lists, [x for x in asked if df[x[0]] <= short * n_docs], [x for x in asked if df[x[0]] > short * n_docs], best, ids, null)
        got += [(i, r + 1, None if best.null[r] else int(best.id[r]), int(best.score[r])) for r in range(len(best.score))]
    assert sorted(got, key=repr) == brute_force(docs, items[:15], 4)

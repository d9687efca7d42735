"""Source divergence audit against a plain recount."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from helpers import awkward, documents

from revspark.llm import divergence, spans

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, min_docs, top):
    """rows of (text, lang, source) to the operator's rows."""
    rows = [(TERM.findall((t or "").translate(LOWER)), g or "", s or "") for t, g, s in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for terms, g, s in rows:
        groups[g].add(s)
        docs[g].update(set(terms))
        counts[g, s].update(terms)
    out = set()
    for g, sources in groups.items():
        kept = [t for t, n in docs[g].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[g, s])

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + (10 ** 9 * (count[t] + 5)) // (total + 5 * len(kept)) for t in kept}

        q = shares(whole)
        p = {s: shares(counts[g, s]) for s in sources}
        for s in sources:
            gaps = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(g, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(gaps)}
            over = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[g, s][t] and p[s][t] > q[t])
            out |= {(g, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(over[:top])}
    return out


def run(spark, rows, min_docs=3, top=4):
    df = spark.createDataFrame([(i, t, g, s) for i, (t, g, s) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string")
    df = df.selectExpr("*", "1 AS block", "2 AS chunk", "3 AS term", "4 AS count", "5 AS rank", "6 AS item", "7 AS value")
    found = [tuple(r) for r in divergence.audit(df, min_docs, top).collect()]
    assert len(found) == len(set(found))
    return set(found)


WORDS = ["Sea", "sea", "sea,", "SEA!sand", "sand", "don't", "é", "été-sea", "Ünder", "x1y", "42", "ﬁ", "a b", "日本", "𝔘𝔫", "-", "İ"]


def sample(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", "\n", "  ", "\t", "\x0b", " \r\n"]) for _ in range(rng.randint(0, 30)))
        rows.append((text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "c", "ä", None])))
    return rows + [(None, "en", "a"), ("", "en", "nothing here"), ("Sea", "xx", "alone"), ("sea sea", "yy", "a"), ("sand", "yy", "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_recount(spark, seed):
    rows = sample(seed, 120)
    assert run(spark, rows) == brute_force(rows, 3, 4)


def test_small_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 300)  # tasks are forked from this process' modules, so also try directly below
    monkeypatch.setattr(divergence, "CELLS", 4)
    rows = sample(3, 150) * 2  # every row twice
    assert run(spark, rows) == brute_force(rows, 3, 4)


def test_awkward_and_empty_tables(spark):
    rows = [(t, "en", s) for _, t, s in awkward()]
    assert run(spark, rows, 5) == brute_force(rows, 5, 4)
    df = documents(spark, [(i, t, s) for i, (t, _, s) in enumerate(rows)])
    assert divergence.audit(df.limit(0)).count() == 0
    assert {r.part for r in divergence.audit(df, 10 ** 6).collect()} == {"pair"}  # no kept term: all pairs, value 0


def test_shares_are_exact_beyond_64_bits(spark):
    n = 9_000_000_000_000_000
    df = spark.createDataFrame([(n, 2 * n, 7)], "n long, total long, v long")
    from pyspark.sql import functions as F
    got = df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + (10 ** 9 * (n + 5)) // (2 * n + 35)


def test_packs_and_spans_keep_every_row():
    texts = ["a bb", None, "", "ccc " * 50, "d", "é è", " \n", "x" * 1000] * 7
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i:i + 10], pa.string()), "at": list(range(i, min(i + 10, 56)))})
               for i in range(0, 56, 10)]
    for limit in (1, 200, 1 << 20):
        at, words = [], []
        for t in spans.packs(batches, "text", limit):
            found = spans.find_spans(*spans.column_bytes(t.column("text")), spans.CHUNK)
            ids = t.column("at").to_pylist()
            at += ids
            raw = found.data.tobytes()
            words += [(ids[r], raw[a:b].decode()) for a, b, r in zip(found.start, found.end, found.row)]
        assert at == list(range(56))
        assert words == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]


def test_texts_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(spans, "span_hash", lambda s: (s.end - s.start).astype("uint64"))
    data, offsets = spans.column_bytes(pa.array(["ab cd ab e", "cd f e"]))
    found = spans.find_spans(data, offsets, spans.CHUNK)
    code, first = spans.distinct_spans(found)
    assert code.tolist() == [0, 1, 0, 2, 1, 3, 2] and spans.span_texts(found, first).to_pylist() == ["ab", "cd", "e", "f"]

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import awkward, documents, sentence
from revspark.llm import near_dup as N


def brute(rows):
    """Links and least id of the group, per row, by the definition."""
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    links, group = defaultdict(set), list(range(len(rows)))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or ():
            holders[x].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s or () for j in holders[x] if j != i)
        links[i] = {j for j, n in shared.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in links:
        for j in links[i]:
            group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, least.get(root(i)) if sets[i] else d, len(links[i])) for i, (d, _, _) in enumerate(rows)), sets, root


def corpus(seed=4):
    rng = random.Random(seed)
    rows = awkward()
    base = 2000
    for size in (2, 3, 30):
        words = sentence(rng, 120).split()
        for k in range(size):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
            rows.append((base + k, " ".join(w) if k % 3 else " ".join(w).upper(), "s0"))
        base += 100
    rows += [(3000 + k, "Exactly the same words here, again!", "s0") for k in range(40)]
    passage = sentence(rng, 30)
    rows += [(4000 + k, sentence(rng, 60) + " " + passage, "s1") for k in range(40)]  # shared, not similar
    return rows


def test_links_and_groups_equal_brute_force(spark):
    rows = corpus()
    got = Counter(tuple(r) for r in N.linked_documents(documents(spark, rows)).collect())
    assert got == brute(rows)[0]


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    rows = corpus(9)
    assert Counter(tuple(r) for r in N.linked_documents(documents(spark, rows)).collect()) == brute(rows)[0]


def test_one_of_each_group_stays(spark):
    rows = corpus()
    _, sets, root = brute(rows)
    df = documents(spark, rows)
    out = N.keep_one_per_group(df)
    assert out.columns == df.columns
    kept = Counter(r["doc_id"] for r in out.collect())
    want = Counter()
    groups = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        if sets[i]:
            groups[root(i)].append(d)
        else:
            want[d] += 1
    for ids in groups.values():
        known = [d for d in ids if d is not None]
        want[min(known) if known else None] += 1
    assert kept == want


def test_words_are_decided_once(spark):
    # no word by the classes' rule, though Java's \\w holds their marks and joiners; then words by theirs, not by Java's
    signs = ["\u2764\ufe0f", "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\u0301\u0308", "\u203f", "\u2764 \u2764"]
    words = ["\u00bd", "\u00b2"]
    rows = [(100 * i + k, t, "s0") for i, t in enumerate(signs + words, 1) for k in range(3)]
    rows += [(None, signs[0], "s0"), (5, "plain words", "s0"), (6, "plain words", "s0")]
    df = documents(spark, rows)
    kept = Counter(r["doc_id"] for r in N.keep_one_per_group(df).collect())
    assert kept == Counter([d for d, t, _ in rows if t in signs] + [600, 700, 5])


def test_empty_table(spark):
    assert N.linked_documents(documents(spark, [])).count() == 0
    assert N.keep_one_per_group(documents(spark, [])).count() == 0


def test_posterior_rule():
    # P(J >= t | m of n) with a uniform prior, by numeric integration
    x = (np.arange(200000) + .5) / 200000
    for n in (16, 64, 128):
        m = N.least_matches(n)
        for matches, reached in ((m, True), (m - 1, False)):
            density = x ** matches * (1 - x) ** (n - matches)
            assert (density[x >= .8].sum() / density.sum() >= N.TOLERANCE) == reached


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    known = N.WordHashes()
    a = sentence(rng, 400, 10 ** 6).split()
    b = a[:300] + sentence(rng, 100, 10 ** 6).split()
    sa, sb = N.shingles(a, known), N.shingles(b, known)
    j = len(np.intersect1d(sa, sb)) / len(np.union1d(sa, sb))
    assert (N.signature(sa) == N.signature(sb)).mean() == pytest.approx(j, abs=0.12)
    assert N.shared_counts([sa, sb])[0, 1] == len(np.intersect1d(sa, sb))


def test_components_of_a_long_chain(spark):
    keys = [f"{i:03d}".encode() for i in range(40)]
    order = list(range(39))
    random.Random(2).shuffle(order)
    df = spark.createDataFrame([(bytearray(keys[i]), bytearray(keys[i + 1])) for i in order if i != 20], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in N.components(df).collect()}
    assert got == {k: keys[0] if i <= 20 else keys[21] for i, k in enumerate(keys)}

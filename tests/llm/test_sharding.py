import random
import zlib
from collections import Counter

from helpers import awkward, documents
from revspark.llm import sharding as S


def test_exact_counts_sizes_and_slots(spark):
    rows = awkward(n=300)
    out = S.shuffle_into_shards(documents(spark, rows).repartition(5), 24).collect()
    assert len(out) == len(rows)
    counts = Counter(r["shard"] for r in out)
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want


def test_matrix_has_the_margins_and_the_hypergeometric_mean():
    blocks = [100, 7, 0, 93, 1]
    m = S.communication_matrix(blocks, 4, 1)
    assert [sum(r) for r in m] == blocks
    assert sorted(sum(c) for c in zip(*m)) == [50, 50, 50, 51]
    rng = random.Random(1)
    draws = [S.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(draws) / 4000 - 6) < 0.1
    var = sum((d - 6) ** 2 for d in draws) / 4000
    assert abs(var - 20 * .3 * .7 * 80 / 99) < 0.25
    assert S.hypergeometric(rng, 0, 5, 3) == 0 and S.hypergeometric(rng, 5, 0, 3) == 3


def test_shuffle_is_uniform_over_shards(spark):
    rows = [(i, str(i), "s") for i in range(2400)]
    out = S.shuffle_into_shards(documents(spark, rows, extra=False).repartition(4), 24, seed=3).collect()
    first = Counter(r["shard"] for r in out if r["doc_id"] < 1200)
    assert all(25 < first[s] < 75 for s in range(24))  # mean 50, five deviations


def test_copies_are_scattered(spark):
    """240 fully equal rows of 2,400: chi-square over 24 shards, 23 degrees of freedom; and slots of a shard."""
    rows = [(7, "copy", "s")] * 240 + [(i + 1000, str(i), "s") for i in range(2160)]
    for blocks, most in ((4, 4096), (9, 3)):  # the second: several scan partitions a block
        old, S.MAX_BLOCKS = S.MAX_BLOCKS, most
        try:
            out = S.shuffle_into_shards(documents(spark, rows, extra=False).repartition(blocks, "text"), 24).collect()
        finally:
            S.MAX_BLOCKS = old
        counts = Counter(r["shard"] for r in out)
        assert set(counts.values()) == {100}
        copies = Counter(r["shard"] for r in out if r["doc_id"] == 7)
        assert sum((copies[s] - 10) ** 2 / 10 for s in range(24)) < 58.6  # exceeded with probability 6e-5
        assert 90 < sum(r["slot"] < 50 for r in out if r["doc_id"] == 7) < 150
        assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(100)) for s in range(24))


def test_fewer_rows_than_shards_and_none(spark):
    assert sorted(r["slot"] for r in S.shuffle_into_shards(documents(spark, [(1, "a", "s"), (1, "a", "s")]), 24).collect()) == [0, 0]
    assert S.shuffle_into_shards(documents(spark, []), 24).count() == 0


def test_native_plan(spark):
    plan = S.shuffle_into_shards(documents(spark, awkward()), 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

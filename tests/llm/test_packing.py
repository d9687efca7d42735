import random
import struct
import zlib
from collections import defaultdict

import pytest

from helpers import awkward, documents
from revspark.llm import packing as K
from revspark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def test_words_remembered_equal_the_tokenizer(tokenizer):
    encode = K.WordIds(tokenizer_path())
    texts = ["It's the dog's 12 bones!!", "ÉTRE où ça — “fin”", "a b\x1cc ½ ² naïve", "", "  \n", "x<|endoftext|>y", "日本語 abc",
             "we'll they've ''s 's 't''re $$$ %%% \"q\"", "A_b c_d_e __ 1a2b", "don't. can't, I'M"]
    spark_docs = [r[0] for r in __import__("duckdb").sql(
        "select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for t in texts + spark_docs + texts:
        assert encode(t) == struct.pack(f"<{len(tokenizer.encode(t, add_special_tokens=False).ids)}I",
                                        *tokenizer.encode(t, add_special_tokens=False).ids)


def test_cache_limit_keeps_results(tokenizer, monkeypatch):
    monkeypatch.setattr(K, "CACHE_WORDS", 3)
    encode = K.WordIds(tokenizer_path())
    for t in ("one two three four five six one", "seven one two eight", "one two three"):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert encode(t) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("n", [1, 2, 31, 63, 64, 500, 819, 820, 1365, 1366, 2048, 2049, 3000, 4095, 4096, 4097, 12345])
def test_cuts_fill_their_class(n):
    cuts = K.cut_lengths(n)
    assert sum(c for c, _ in cuts) == n
    for size, k in cuts:
        assert 1 <= size and k * size <= K.CAPACITY < (k + 1) * size + k + 1
        assert 1 - k * size / K.CAPACITY <= K.MAX_WASTE or n < K.CAPACITY and size == n


def check(spark, rows, tokenizer):
    out = K.pack_documents(documents(spark, rows), tokenizer_path()).collect()
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= K.CAPACITY
    return out, sequences, pieces


def test_round_trip_and_fill(spark, tokenizer):
    rng = random.Random(1)
    rows = awkward() + [(5000 + i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 1500))), "s0") for i in range(150)]
    out, sequences, pieces = check(spark, rows, tokenizer)
    once = {i: t for i, t, _ in rows if i != 1004}
    for i, t in once.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i])
        assert b"".join(p for _, p, _ in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert [s for s, _, _ in own] == [sum(len(p) // 4 for _, p, _ in own[:k]) for k in range(len(own))]
        assert all(n == len(ids) for _, _, n in own)
    used = sum(r["length"] for r in out)
    assert used / (len(sequences) * K.CAPACITY) > 0.93


def test_few_and_no_documents(spark, tokenizer):
    out, _, pieces = check(spark, [(1, None, "s"), (2, "", "s")], tokenizer)
    assert len(out) == 2 and all(p[0][1] == struct.pack("<I", 2) for p in pieces.values())
    assert K.pack_documents(documents(spark, []), tokenizer_path()).count() == 0


def test_query_checksums(spark, tokenizer):
    from revspark.llm.queries import QUERIES
    rows = QUERIES["op8_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]

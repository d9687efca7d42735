"""Harmonic packing of documents into fixed-size sequences.

A piece of r tokens belongs to class k = capacity // r: exactly k pieces of the
class fill a sequence. Classes are independent; within one, a piece's rank // k
is its sequence, so workers fill bins without looking at each other's lengths.

A document is cut freely: whole sequences first, then, where k pieces as long as
the rest would leave more than ``MAX_WASTE`` of a sequence empty, at the next
reciprocal length capacity // (k + 1), which fills class k + 1 exactly. Only the
last, incomplete sequence of each class is left over; those leftovers (at most
k - 1 pieces a class, whatever the input) are packed together first-fit decreasing.

Defined results: a null text is empty; an empty text is the single end token;
null ids and repeated rows are documents of their own; an empty table gives no
rows. Only id and text are read, whatever else the table has.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.common import ranked, staged

CAPACITY = 4096
END_ID = 2
MAX_WASTE = 0.04
#: Pieces of one class that a task ranks on average.
BUCKET_ROWS = 8192
#: Words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 800_000

# What these texts' characters are split into by the vocabulary's own pattern, after
# lower-casing; texts with any other character go through the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*\Z")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class WordIds:
    """Ids of a text as little-endian 32-bit bytes, remembering white-space separated words.

    The vocabulary's splitting never crosses white space and its ids mark word ends, so
    many new words are encoded in one call and cut apart at the marks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        ids = np.asarray(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        last = np.cumsum([len(_WORDS.findall(w)) for w in words]) - 1
        raw, start = ids.tobytes(), 0
        for w, end in zip(words, (ends[last] * 4).tolist()):
            self.known[w] = raw[start:end]
            start = end

    def __call__(self, text: str) -> bytes:
        if not _PLAIN.match(text) or "<|" in text:
            return self.whole(text)
        words = text.lower().split()
        got = list(map(self.known.get, words))
        if None in got:
            new = list(dict.fromkeys(w for w, g in zip(words, got) if g is None))
            self.learn(new)
            got = [g if g is not None else self.known[w] for w, g in zip(words, got)]
        return b"".join(got)


_ENCODERS: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def cut_lengths(n: int, capacity: int = CAPACITY, max_waste: float = MAX_WASTE) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``n`` tokens, in order."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if 1 - k * rest / capacity <= max_waste:
            pieces.append((rest, k))
            break
        step = capacity // (k + 1)
        if step == 0 or step >= rest:
            pieces.append((rest, k))
            break
        pieces.append((step, k + 1))
        rest -= step
    return pieces


def cut_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces: ``id_col``, ``start``, ``length``, ``doc_tokens``, ``class``, ``ids`` (bytes, 4 a token)."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, len(texts), 256):
                own, start, length, total, cls, raw = [], [], [], [], [], []
                for i, text in enumerate(texts.slice(at, 256).to_pylist(), at):
                    tokens = encode(text or "") + end
                    n, pos = len(tokens) // 4, 0
                    for size, k in cut_lengths(n, capacity):
                        own.append(i)
                        start.append(pos)
                        length.append(size)
                        total.append(n)
                        cls.append(k)
                        raw.append(tokens[4 * pos:4 * (pos + size)])
                        pos += size
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(own, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(cls, pa.int32()), pa.array(raw, pa.binary())],
                    names=[id_col, "start", "length", "doc_tokens", "class", "ids"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, start long, length long, doc_tokens long, class int, ids binary")


def _first_fit_decreasing(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        room, first, place = [], 0, []
        for size in pdf["length"]:
            while first < len(room) and room[first] == 0:
                first += 1
            for i in range(first, len(room)):
                if room[i] >= size:
                    break
            else:
                i = len(room)
                room.append(capacity)
            room[i] -= size
            place.append(i)
        return pd.DataFrame({"_uid": pdf["_uid"], "_bin": np.asarray(place, dtype=np.int64)})
    return run


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``length`` and ``class``.

    Sequence ids: class * 2**40 + number within the class; leftovers count from 0.
    """
    cols = pieces.columns
    rows = staged(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    rows = (rows.withColumn("_h", F.xxhash64(F.lit(8), "_uid"))
            .withColumn("_bucket", F.floor(F.shiftrightunsigned("_h", 32) / F.lit(float(1 << 32)) * buckets)
                        .cast("long")))
    placed = ranked(rows, ["class"], "_bucket", ["_h", "_uid"], out="_rank")
    # one row a class, at most `capacity` rows
    full = {r["class"]: r["n"] // r["class"] * r["class"]
            for r in rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not full:
        return placed.select(*cols, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bounds = rows.sparkSession.createDataFrame(list(full.items()), "class int, _full long")
    placed = staged(placed.join(F.broadcast(bounds), "class").drop("_h", "_bucket"), "placed")
    rest = (placed.where(F.col("_rank") >= F.col("_full")).select("_uid", "length", F.lit(0).alias("g"))
            .groupBy("g").applyInPandas(_first_fit_decreasing(capacity), "_uid long, _bin long"))
    own = F.col("class").cast("long") * (1 << 40) + F.floor(F.col("_rank") / F.col("class")).cast("long")
    whole = placed.where(F.col("_rank") < F.col("_full")).withColumn("sequence_id", own)
    left = (placed.where(F.col("_rank") >= F.col("_full")).join(F.broadcast(rest), "_uid")  # bounded, see above
            .withColumnRenamed("_bin", "sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy("_uid").rowsBetween(Window.unboundedPreceding, -1)
    return (whole.select(*cols, "_uid", "sequence_id").unionByName(left.select(*cols, "_uid", "sequence_id"))
            .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
            .drop("_uid"))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their token ids, sequence and offset."""
    return place_pieces(cut_documents(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity),
                        capacity)

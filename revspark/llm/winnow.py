"""Benchmark decontamination by winnowing.

A text's words are hashed in grams of ``GRAM`` words; of every ``window - GRAM + 1``
neighbouring grams the one of the least hash is kept (the leftmost, on ties). Two texts
that share ``window`` words in a row share all grams of that span, hence the one kept:
no shared span of that length is missed, whatever surrounds it. An item of fewer words
than ``window`` is one window; for each such length all grams of that length are kept.

Kept grams of documents that pass a bit table of the items' grams (of fixed size, so
any benchmark will do) are joined with the items' grams. A gram that meets one is
extended: every window of words around it is looked up among the items' windows by its
text, so no hash decides a result. Documents of equal text are searched once.

Bounds: the bit table, 2 MB; a document's kept grams. Tables of items are broadcast
only if counted to be small, and are otherwise joined by shuffle.

Defined results: null or wordless texts have no words and no hits; rows of equal item
id are one item with the windows of all; an item without words has no window; a null
item id counts as an item, written as an empty string; repeated documents, and null
ids, are rows like any others; an empty table of documents gives no rows. Only id and
text are read, whatever else the tables have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.common import sized_broadcast, staged, text_or_empty
from revspark.llm.spans import LOWER, WORD, Spans, column_bytes, find_spans, mix, one_array, packs, span_hash

#: Words of a hashed gram.
GRAM = 5
#: The bit table holds 2 ** BITS bits.
BITS = 24
BLOCK = 1 << 22
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def grams(words: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place; 0 where they are not of one row."""
    n = max(len(words) - k + 1, 0)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[j:j + n])
    out[row[:n] != row[k - 1:k - 1 + n]] = 0
    return out


def winnowed(words: np.ndarray, row: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams kept: the least of each window's grams."""
    g = grams(words, row, k)
    n = max(len(words) - window + 1, 0)
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - k + 1):
        here = g[j:j + n]
        less = here < least
        np.copyto(least, here, where=less)
        at[less] = j
    whole = row[:n] == row[window - 1:window - 1 + n]
    kept = np.zeros(len(g), bool)
    kept[(np.arange(n) + at)[whole]] = True
    kept = np.flatnonzero(kept)
    return kept, g[kept]


def _word_hashes(texts) -> tuple[Spans, np.ndarray]:
    data, offsets = column_bytes(texts)
    found = find_spans(LOWER[data], offsets, WORD)
    return found, span_hash(found)


def _item_grams(short: list[int], window: int):
    """Task: kept grams of the items."""
    def run(batches):
        for rows in packs(batches, "text", BLOCK):
            found, words = _word_hashes(rows.column("text"))
            size = np.bincount(found.row, minlength=rows.num_rows)
            out = [winnowed(words, found.row, GRAM, window)[1]]
            for m in short:
                mine = size[found.row] == m
                out.append(winnowed(words[mine], found.row[mine], m, m)[1])
            yield pa.RecordBatch.from_pydict({"gram": pa.array(np.concatenate(out).view(np.int64))})
    return run


_HIT = pa.struct([("gram", pa.int64()), ("first", pa.int64()), ("span", pa.int32()), ("words", pa.string())])


def _candidates(bits: np.ndarray, short: list[int], window: int):
    """Task: words of each document, and the kept grams the bit table lets pass, in context."""
    def known(g):
        at = g >> np.uint64(64 - BITS)
        return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0

    def run(batches):
        for rows in packs(batches, "text", BLOCK):
            found, words = _word_hashes(rows.column("text"))
            size = np.bincount(found.row, minlength=rows.num_rows)
            first = np.cumsum(size) - size
            hits = []  # place, gram, first and last word of its context, window length
            for k, span in [(GRAM, window), *((m, m) for m in short)]:
                at, g = winnowed(words, found.row, k, span)
                ok = known(g)
                at, g = at[ok], g[ok]
                lo = np.maximum(at - (span - k), first[found.row[at]])
                hi = np.minimum(at + span, (first + size)[found.row[at]])
                hits.append(np.stack([found.row[at], lo, hi, np.full(len(at), span), g.view(np.int64)], axis=1))
            hits = np.concatenate(hits)
            hits = hits[np.argsort(hits[:, 0], kind="stable")]
            raw = found.data.tobytes()
            start, end = found.start, found.end
            context = [b" ".join(raw[start[i]:end[i]] for i in range(lo, hi)).decode() for lo, hi in hits[:, 1:3]]
            cuts = np.zeros(rows.num_rows + 1, np.int32)
            np.cumsum(np.bincount(hits[:, 0], minlength=rows.num_rows), out=cuts[1:])
            structs = pa.StructArray.from_arrays(
                [pa.array(hits[:, 4]), pa.array(hits[:, 1] - first[hits[:, 0]]), pa.array(hits[:, 3], pa.int32()),
                 pa.array(context, pa.string())], fields=list(_HIT))
            data, offsets = column_bytes(rows.column("text"))
            data = data.tobytes()
            digest = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [one_array(rows.column("doc")), pa.array(digest, pa.binary()),
                 pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), structs)],
                names=["doc", "digest", "n_words", "hits"])
    return run


def _windows(words: Column, span: Column) -> Column:
    """Texts of all runs of ``span`` words."""
    places = F.sequence(F.lit(1), F.size(words) - span + 1)
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, span), " "))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``window``: the distinct windows of each item, by text."""
    lower = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col(id_col).cast("string").alias("item"),
                         F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0)).alias("words"))
    words = words.where(F.size("words") > 0)
    found = _windows(F.col("words"), F.least(F.size("words"), F.lit(window)))
    return words.select("item", F.explode(found).alias("window")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, *, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``n_hit`` (its words inside a window that an
    item has), ``items`` (sorted ids of those items, as strings).
    """
    spark = docs.sparkSession
    of_items = staged(item_windows(items, window, item_id_col, item_text_col), "winnow-items")
    lengths = of_items.select(F.size(F.split("window", " ", -1)).alias("n")).where(F.col("n") < window).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # at most window - 1 numbers
    texts = items.select(text_or_empty(item_text_col).alias("text"))
    item_grams = staged(texts.mapInArrow(_item_grams(short, window), "gram long").distinct(), "winnow-grams")
    top = F.shiftrightunsigned("gram", 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(top, F.lit(64)).cast("int"))
    table = item_grams.groupBy(F.shiftright(top, 6).alias("at")).agg(F.bit_or(bit).alias("bits"))
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    for r in table.toLocalIterator():  # at most 2 ** (BITS - 6) rows
        bits[r["at"]] = np.uint64(r["bits"] & (2 ** 64 - 1))

    rows = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    doc_type = rows.schema["doc"].dataType.simpleString()
    seen = staged(rows.mapInArrow(
        _candidates(bits, short, window),
        f"doc {doc_type}, digest binary, n_words long, hits array<struct<gram:long,first:long,span:int,words:string>>"),
        "winnow-documents")

    # join of fingerprints, then every window around a shared one
    met = (seen.where(F.size("hits") > 0).select("digest", F.explode("hits").alias("hit"))
           .select("digest", "hit.*").dropDuplicates(["digest", "first", "span", "gram"])
           .join(sized_broadcast(item_grams), "gram", "left_semi"))
    around = met.select("digest", "first", "span", F.posexplode(_windows(F.split("words", " ", -1), F.col("span"))).alias("i", "window"))
    around = (around.select("digest", (F.col("first") + F.col("i")).alias("start"), "span", "window")
              .dropDuplicates(["digest", "start", "span"]))
    texts_of_items = of_items.select("window").distinct()
    found = staged(around.join(sized_broadcast(texts_of_items), "window", "left_semi"), "winnow-windows")

    # words covered by a document's windows, each counted once
    earlier = Window.partitionBy("digest").orderBy("start", "span").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("span")
    covered = (found.withColumn("done", F.coalesce(F.max(end).over(earlier), F.lit(0)))
               .groupBy("digest").agg(F.sum(F.greatest(end - F.greatest("start", "done"), F.lit(0))).alias("n_hit")))
    pairs = (found.select("digest", "window").distinct().join(sized_broadcast(of_items), "window")
             .select("digest", F.coalesce("item", F.lit("")).alias("item")).distinct())
    leaked = pairs.groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = staged(covered.join(leaked, "digest"), "winnow-results")

    clean = (seen.where(F.size("hits") == 0)
             .select(F.col("doc").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"),
                     F.array().cast("array<string>").alias("items")))
    hit = (seen.where(F.size("hits") > 0).select("doc", "digest", "n_words").join(sized_broadcast(result), "digest", "left")
           .select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                   F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    return clean.unionByName(hit)

"""Ranked lexical search by hybrid term-at-a-time, document-at-a-time evaluation.

Documents are taken in blocks of about ``BLOCK`` bytes of text. A block keeps, for the
terms any item asks for, its list of (document, occurrences), and the length of each
document; the blocks are written once. Counts over all of them give the terms' weights.

A query's short lists (terms in at most ``SHORT`` of all documents) are summed first,
term at a time, into accumulators. Over all blocks the kth best accumulator is a score
that the kth result reaches at least. Then each block is read again: the accumulators
are one iterator, with their greatest sum as its bound, beside the long lists, each
with its greatest gain as its bound. They advance together over ranges of documents in
order. In a range, the iterators whose bounds together stay below the kth score so far
propose no document and are only looked up, as long as the rest can still reach it; a
range whose bounds all together stay below it is skipped.

Bounds: a block; the terms of ``QUERY_PAIRS`` (item, term) pairs, which go to every task
(further items are asked in further rounds, each over blocks of its own); k results a
query and task.

Defined results: a text without terms is no document; rows of equal item id are one
item with the terms of all, a null id is an item too; items without terms have no
results; repeated documents are ranked one by one; equal scores by smaller id, null ids
last; an empty table gives no rows. Only id and text are read, whatever else the tables
have.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.common import staged, text_or_empty
from revspark.llm.divergence import pack, pairs_of, sums_of, unpack
from revspark.llm.spans import LOWER, WORD, column_bytes, distinct_spans, find_spans, one_array, packs, span_texts

BLOCK = 1 << 24
#: A term in at most this share of all documents has a short list.
SHORT = 1 / 64
#: Documents of a range.
RANGE = 2048
#: (item, term) pairs of a round, on average.
QUERY_PAIRS = 1 << 21
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_INDEX = "docs long, terms long, ids array<long>, held array<struct<term:int,df:long>>, body binary"


def _index(vocabulary: list[str]):
    """Task: its documents as blocks of lists of the wanted terms."""
    wanted = pa.array(vocabulary, pa.string())
    held_type = pa.list_(pa.struct([("term", pa.int32()), ("df", pa.int64())]))

    def run(batches):
        for rows in packs(batches, "text", BLOCK):
            data, offsets = column_bytes(rows.column("text"))
            found = find_spans(LOWER[data], offsets, WORD)
            code, first = distinct_spans(found)
            number = pc.fill_null(pc.index_in(span_texts(found, first), value_set=wanted), -1).to_numpy().astype(np.int64)
            size = np.bincount(found.row, minlength=rows.num_rows)
            term = number[code]
            doc, term, codes = pairs_of(found.row[term >= 0], term[term >= 0], len(wanted))
            times = np.bincount(codes, minlength=len(doc))
            order = np.lexsort((doc, term))
            doc, term, times = doc[order], term[order], times[order]
            terms, df = np.unique(term, return_counts=True)
            held = pa.StructArray.from_arrays([pa.array(terms, pa.int32()), pa.array(df, pa.int64())], ["term", "df"])
            yield pa.RecordBatch.from_arrays([
                pa.array([int((size > 0).sum())]), pa.array([int(size.sum())]),
                pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), one_array(rows.column("doc"))),
                pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), held).cast(held_type),
                pa.array([pack(size, terms, df, doc, times)], pa.binary())],
                names=["docs", "terms", "ids", "held", "body"])
    return run


class _Lists:
    """One block: documents and gains (before weights) of each term's list."""

    def __init__(self, body: bytes, n_docs: int, n_terms: int):
        size, terms, df, self.docs, times = unpack(body, 5)
        self.n = len(size)
        norm = 100 - 25 + (25 * size * n_docs) // n_terms
        self.gain = (1_000_000_000 * times) // (1000 * times + 12 * norm[self.docs])
        end = np.cumsum(df)
        self.place = {int(t): (int(e - d), int(e)) for t, d, e in zip(terms, df, end)}

    def scored(self, wanted: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, scores) of the terms the block has, for (term, weight) pairs."""
        out = []
        for term, weight in wanted:
            at = self.place.get(term)
            if at and weight:
                out.append((self.docs[at[0]:at[1]], weight * self.gain[at[0]:at[1]]))
        return out

    def accumulators(self, wanted: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Documents and summed scores of the short lists, in document order."""
        lists = self.scored(wanted)
        if not lists:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, codes = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
        return docs, sums_of(codes, np.concatenate([s for _, s in lists]), len(docs))


class _Best:
    """The k best (score, id) seen of one query."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(least, 1)  # scores below it can not be among the results
        self.score, self.id, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score = np.concatenate([self.score, score])
        ids, null = np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        top = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[top], ids[top], null[top]
        if len(top) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def _search(lists: _Lists, short, long, best: _Best, ids, null) -> None:
    """One query over one block: accumulators and long lists, range by range."""
    iterators = [x for x in [lists.accumulators(short), *lists.scored(long)] if len(x[0])]
    if not iterators:
        return
    edges = np.arange(0, lists.n + RANGE, RANGE)
    cuts = [np.searchsorted(docs, edges) for docs, _ in iterators]
    for r in range(len(edges) - 1):
        parts = [(docs[c[r]:c[r + 1]], s[c[r]:c[r + 1]]) for (docs, s), c in zip(iterators, cuts) if c[r] < c[r + 1]]
        parts.sort(key=lambda x: int(x[1].max()))
        reach = np.cumsum([int(s.max()) for _, s in parts])  # bound of the first iterators together
        if not parts or reach[-1] < best.least:
            continue
        lookups = int(np.searchsorted(reach, best.least))  # that many propose nothing
        score = np.zeros(RANGE, np.int64)
        seen = np.zeros(RANGE, bool)
        for docs, s in parts[lookups:]:
            score[docs - edges[r]] += s
            seen[docs - edges[r]] = True
        found = np.flatnonzero(seen)
        score = score[found]
        for i in range(lookups - 1, -1, -1):
            keep = score + reach[i] >= best.least
            found, score = found[keep], score[keep]
            docs, s = parts[i]
            at = np.searchsorted(docs, found + edges[r])
            at[at == len(docs)] = 0
            score = score + np.where(docs[at] == found + edges[r], s[at], 0)
        keep = score >= best.least
        if keep.any():
            doc = found[keep] + edges[r]
            best.add(score[keep], ids[doc], null[doc])


def _blocks(batches):
    for b in batches:
        for i in range(b.num_rows):
            ids = b.column("ids").slice(i, 1).flatten()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            yield b.column("body")[i].as_py(), pc.fill_null(ids, 0).to_numpy(), null


def _least_scores(queries, n_docs: int, n_terms: int, k: int):
    """Task: its k best accumulators of each query."""
    def run(batches):
        best = [_Best(k, 1) for _ in queries]
        for body, ids, null in _blocks(batches):
            lists = _Lists(body, n_docs, n_terms)
            for (short, _), top in zip(queries, best):
                docs, score = lists.accumulators(short)
                keep = score >= top.least
                top.add(score[keep], ids[docs[keep]], null[docs[keep]])
        yield _rows(best)
    return run


def _results(queries, least: list[int], n_docs: int, n_terms: int, k: int):
    """Task: its k best documents of each query that reach the query's least score."""
    def run(batches):
        best = [_Best(k, x) for x in least]
        for body, ids, null in _blocks(batches):
            lists = _Lists(body, n_docs, n_terms)
            for (short, long), top in zip(queries, best):
                _search(lists, short, long, top, ids, null)
        yield _rows(best)
    return run


def _rows(best: list[_Best]) -> pa.RecordBatch:
    n = [len(x.score) for x in best]
    none = [np.empty(0, np.int64)]
    ids = pa.array(np.concatenate([x.id for x in best] + none), pa.int64(),
                   mask=np.concatenate([x.null for x in best] + [np.empty(0, bool)]))
    return pa.RecordBatch.from_pydict({"query": pa.array(np.repeat(np.arange(len(best)), n), pa.int32()), "doc_id": ids,
                                       "score": pa.array(np.concatenate([x.score for x in best] + none), pa.int64())})


def _round(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame | None:
    """Results of the items of ``wanted`` (``item``, ``term``, ``times``), a bounded number."""
    spark = docs.sparkSession
    asked_of: dict = {}
    for r in wanted.select("item", "term", "times").collect():  # QUERY_PAIRS of them, on average
        asked_of.setdefault(r["item"], []).append((r["term"], r["times"]))
    if not asked_of:
        return None
    terms = sorted({t for asked in asked_of.values() for t, _ in asked})
    numbers = {t: i for i, t in enumerate(terms)}
    blocks = staged(docs.mapInArrow(_index(terms), _INDEX), "lexical-blocks")
    total = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"),
                       F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"]
    if n_docs == 0:
        return None
    # at most one row a wanted term
    df = {r["term"]: r["df"] for r in blocks.select(F.explode("held").alias("h")).groupBy(F.col("h.term").alias("term"))
          .agg(F.sum("h.df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    ids, queries = [], []
    for item, of_item in asked_of.items():
        ids.append((len(ids), item))
        asked = [(numbers[t], n) for t, n in of_item if numbers[t] in df]
        short = [(t, weight[t] * n) for t, n in asked if df[t] <= SHORT * n_docs]
        long = [(t, weight[t] * n) for t, n in asked if df[t] > SHORT * n_docs]
        queries.append((short, long))

    schema = "query int, doc_id long, score long"
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    partial = blocks.select("ids", "body").mapInArrow(_least_scores(queries, n_docs, n_terms, k), schema)
    least = {r["query"]: r["score"] for r in partial.withColumn("rank", F.row_number().over(order))
             .where(F.col("rank") <= k).where(F.col("rank") == k).select("query", "score").collect()}
    found = blocks.select("ids", "body").mapInArrow(
        _results(queries, [least.get(q, 1) for q in range(len(queries))], n_docs, n_terms, k), schema)
    names = spark.createDataFrame(ids, f"query int, item_id {wanted.schema['item'].dataType.simpleString()}")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(F.broadcast(names), "query")  # the items of a round
            .select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = 20, *, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` of each item's k best documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    lower = F.translate(text_or_empty(item_text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = staged(items.select(F.col(item_id_col).alias("item"),
                                 F.explode(F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))).alias("term"))
                    .groupBy("item", "term").agg(F.count(F.lit(1)).alias("times")), "lexical-items")
    rounds = max(1, -(-wanted.count() // QUERY_PAIRS))
    out = None
    for i in range(rounds):
        part = _round(rows, wanted.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == i), k)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    kind = wanted.schema["item"].dataType.simpleString()
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")

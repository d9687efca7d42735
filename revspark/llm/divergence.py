"""Source divergence audit by chunk factorisation.

Every document's text is cut at ASCII white space and its chunks are counted; terms
never cross white space. Documents are taken in blocks of about ``BLOCK`` bytes, each
with its own list of distinct chunks and, per document, chunk numbers and counts. The
lists meet in one exchange by chunk: there each globally distinct chunk is tokenized
once and its terms are joined to all blocks that list it. Bundles of ``BUNDLE`` blocks
then count, per language, source and term, distinct documents and occurrences; sums of
these give the terms to keep, their shares and the divergences.

Bounds: a bundle, a chunk's list of blocks (streamed, never collected) and the sources
of one language. Counts are 64-bit, shares are computed in 38-digit decimals.

Defined results: null text, lang and source read as ''; rows of equal id, or fully
repeated ones, are documents of their own; a language of one source gives no ``pair``
rows; a group without terms is compared like any other, by its smoothed shares; ties
go to the smaller item in UTF-8 order; an empty table gives no rows. Only the three
named columns are read, whatever else the table has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.common import staged, text_or_empty
from revspark.llm.spans import CHUNK, column_bytes, distinct_spans, find_spans, one_array, packs, span_texts

#: Bytes of text of a block.
BLOCK = 1 << 24
#: Blocks counted together, on average.
BUNDLE = 4
#: Cells (terms x sources) that one task holds when sources are compared.
CELLS = 1 << 16
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
SMOOTH = 5

_BLOCKS = "block long, langs array<string>, sources array<string>, body binary, chunks binary, lengths binary"


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(body: bytes) -> bytes:
    return pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)


def pack(*arrays: np.ndarray) -> bytes:
    """Little-endian 32-bit arrays behind their lengths, compressed byte place by byte place."""
    raw = np.concatenate([[len(a) for a in arrays], *arrays]).astype("<i4")
    return _squeeze(raw.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(body: bytes, n: int) -> list[np.ndarray]:
    raw = np.ascontiguousarray(np.frombuffer(_expand(body), np.uint8).reshape(4, -1).T).view("<i4").ravel()
    cuts = np.cumsum(raw[:n])
    return [raw[n + a:n + b].astype(np.int64) for a, b in zip(np.r_[0, cuts[:-1]], cuts)]


def pairs_of(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a, b) with b < width, and the number of each entry's pair."""
    codes, keys = pd.factorize(a * max(width, 1) + b)
    return keys // max(width, 1), keys % max(width, 1), codes


def _factorise(batches):
    """Task: its documents as blocks of distinct chunks and per-document chunk counts."""
    base = TaskContext.get().partitionId() << 33
    number = 0
    for some in packs(batches, "text", 2 * BLOCK):  # documents of one language share most chunks
        for rows in packs(some.sort_by("lang").to_batches(), "text", BLOCK):
            spans = find_spans(*column_bytes(rows.column("text")), CHUNK)
            chunk, first = distinct_spans(spans)
            pairs, count = summed(spans.row * max(len(first), 1) + chunk, np.ones(len(chunk), np.int64))
            doc, chunk = pairs // max(len(first), 1), pairs % max(len(first), 1)
            steps = np.diff(chunk, prepend=0)  # from the document's chunk before
            new = np.diff(doc, prepend=-1) > 0
            steps[new] = chunk[new]
            langs, sources = (one_array(rows.column(c)).dictionary_encode() for c in ("lang", "source"))
            lang_no, source_no, group = pairs_of(langs.indices.to_numpy().astype(np.int64),
                                                 sources.indices.to_numpy().astype(np.int64), len(sources.dictionary))
            texts = span_texts(spans, first)
            yield pa.RecordBatch.from_pydict({
                "block": [base + number],
                "langs": [langs.dictionary.take(pa.array(lang_no)).to_pylist()],
                "sources": [sources.dictionary.take(pa.array(source_no)).to_pylist()],
                "body": [pack(group, np.bincount(doc, minlength=len(group)), steps, count)],
                "chunks": [_squeeze(column_bytes(texts)[0].tobytes())],
                "lengths": [pack(np.diff(column_bytes(texts)[1]))],
            }, schema=pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())),
                                 ("body", pa.binary()), ("chunks", pa.binary()), ("lengths", pa.binary())]))
            number += 1


def _list_chunks(batches):
    """Task: one row per distinct chunk of each block."""
    for b in batches:
        for block, chunks, lengths in zip(*(b.column(c).to_pylist() for c in ("block", "chunks", "lengths"))):
            length, = unpack(lengths, 1)
            offsets = np.zeros(len(length) + 1, np.int64)
            np.cumsum(length, out=offsets[1:])
            texts = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(_expand(chunks)))
            for at in range(0, len(length), 1 << 16):
                part = texts.slice(at, 1 << 16).cast(pa.string())
                n = len(part)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(n, block), pa.int64()), "chunk_no": pa.array(np.arange(at, at + n), pa.int32()),
                    "chunk": part})


_COUNTS = "lang string, term string, docs long, sources array<string>, counts array<int>"


def _count_terms(terms: pa.Table, blocks: pa.Table) -> pa.Table:
    """Some blocks: documents of each of their terms by language, occurrences by source."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()),
                        ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])
    if terms.num_rows == 0 or blocks.num_rows == 0:
        return schema.empty_table()
    lists = pc.split_pattern(one_array(terms.column("terms")), " ")
    coded = lists.flatten().dictionary_encode()
    size_of = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    block_of, chunk_of = (np.repeat(terms.column(c).to_numpy().astype(np.int64), size_of) for c in ("block", "chunk_no"))
    order = np.lexsort((chunk_of, block_of))
    block_of, chunk_of, term_of = block_of[order], chunk_of[order], coded.indices.to_numpy().astype(np.int64)[order]
    del lists, order
    n_terms = len(coded.dictionary)
    groups: dict[tuple[str, str], int] = {}
    key, docs, count = (np.empty(0, np.int64) for _ in range(3))  # key: group number * n_terms + term
    for row in blocks.select(["home", "langs", "sources", "body"]).to_pylist():
        lo, hi = np.searchsorted(block_of, [row["home"], row["home"] + 1])
        group, per_doc, steps, n_chunk = unpack(row["body"], 4)
        chunk = np.cumsum(steps)
        first = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
        chunk -= np.repeat(chunk[first] - steps[first], per_doc[per_doc > 0])
        numbers = np.array([groups.setdefault(g, len(groups)) for g in zip(row["langs"], row["sources"])], np.int64)
        # the terms of chunk number c: term_of[lo + begin[c]:lo + begin[c] + size[c]]
        size = np.bincount(chunk_of[lo:hi], minlength=int(chunk.max(initial=0)) + 1)
        begin = np.cumsum(size) - size
        n = size[chunk]
        doc, n_chunk = np.repeat(np.repeat(np.arange(len(group)), per_doc), n), np.repeat(n_chunk, n)
        at = lo + np.repeat(begin[chunk], n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        in_doc, n_term = summed(doc * n_terms + term_of[at], n_chunk)
        del doc, n_chunk, at
        keys, n_docs, n_term = summed(numbers[group[in_doc // n_terms]] * n_terms + in_doc % n_terms,
                                      np.ones(len(in_doc), np.int64), n_term)
        key, docs, count = summed(*(np.concatenate(x) for x in ((key, keys), (docs, n_docs), (count, n_term))))

    group, term = key // n_terms, key % n_terms
    langs = {x: i for i, x in enumerate(dict.fromkeys(g for g, _ in groups))}
    lang = np.array([langs[g] for g, _ in groups], np.int64)[group]
    alphabetical = np.empty(n_terms, np.int64)  # neighbours compress better
    alphabetical[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(n_terms)
    order = np.lexsort((group, alphabetical[term], lang))
    group, term, lang, docs, count = (x[order] for x in (group, term, lang, docs, count))
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])][:len(term)])
    cuts = pa.array(np.r_[new, len(term)], pa.int32())
    return pa.Table.from_arrays([
        pa.array(list(langs), pa.string()).take(pa.array(lang[new])), coded.dictionary.take(pa.array(term[new])),
        pa.array(np.add.reduceat(docs, new) if len(new) else docs, pa.int64()),
        pa.ListArray.from_arrays(cuts, pa.array([s for _, s in groups], pa.string()).take(pa.array(group))),
        pa.ListArray.from_arrays(cuts, pa.array(count, pa.int32()))], schema=schema)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the exact sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    return (keys[new], *(np.add.reduceat(v[order], new) if len(new) else v for v in values))


def sums_of(codes: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums of ``values`` by code."""
    out = np.zeros(n, np.int64)
    np.add.at(out, codes, values)
    return out


def term_counts(docs: DataFrame, min_docs: int = 30, *, text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``lang``, ``source``, ``term``, ``count`` of the kept terms that occur there, and the groups.

    A term is kept by a language of which at least ``min_docs`` documents hold it.
    """
    rows = docs.select(text_or_empty(text_col).alias("text"), text_or_empty(lang_col).alias("lang"),
                       text_or_empty(source_col).alias("source"))
    blocks = staged(rows.mapInArrow(_factorise, _BLOCKS), "divergence-blocks")
    bundles = max(1, blocks.count() // BUNDLE)  # blocks counted together share most terms

    def bundle(block):
        return F.pmod(F.xxhash64(block), F.lit(bundles))
    bodies = blocks.select(bundle("block").alias("of_bundle"), F.col("block").alias("home"), "langs", "sources", "body")
    groups = (blocks.select(F.explode(F.arrays_zip("langs", "sources")).alias("g"))
              .select(F.col("g.langs").alias("lang"), F.col("g.sources").alias("source")).distinct())

    lists = blocks.select("block", "chunks", "lengths").mapInArrow(_list_chunks, "block long, chunk_no int, chunk string")
    # A chunk's rows meet in one place, in order of block. The first of them is tokenized, the
    # others take its terms; they pass one by one, however many blocks list the chunk.
    same = Window.partitionBy("chunk").orderBy("block")
    lower = F.translate("chunk", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    once = F.when(F.col("at") == 1, F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
    back = (lists.withColumn("at", F.row_number().over(same)).withColumn("terms", once)
            .withColumn("terms", F.first("terms").over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .where(F.size("terms") > 0)
            .select(bundle("block").alias("bundle"), "block", "chunk_no", F.array_join("terms", " ").alias("terms")))
    counted = (back.groupBy("bundle").cogroup(bodies.groupBy("of_bundle"))
               .applyInArrow(_count_terms, _COUNTS)
               .repartition("lang", "term")
               .select("lang", "term", "docs", F.posexplode(F.arrays_zip("sources", "counts")).alias("i", "x"))
               .groupBy("lang", "term", F.col("x.sources").alias("source"))
               .agg(F.sum(F.when(F.col("i") == 0, F.col("docs")).otherwise(0)).alias("docs"), F.sum("x.counts").alias("count")))
    everywhere = Window.partitionBy("lang", "term")
    kept = (counted.withColumn("held", F.sum("docs").over(everywhere)).where(F.col("held") >= min_docs)
            .select("lang", "source", "term", "count"))
    return staged(kept, "divergence-counts"), staged(groups, "divergence-groups")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact."""
    wide = (count.cast("decimal(20,0)") + F.lit(SMOOTH)).cast("decimal(21,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = total.cast("decimal(20,0)") + F.lit(SMOOTH).cast("decimal(1,0)") * terms.cast("decimal(18,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, under)


_GAPS = "lang string, source string, other string, gap long"


def _gaps(shares: pa.Table, groups: pa.Table) -> pa.Table:
    """One slice of a language's terms: summed share differences of each pair of its sources."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("gap", pa.int64())])
    if groups.num_rows < 2:
        return schema.empty_table()
    names = groups.column("source").to_pylist()
    where = {s: i for i, s in enumerate(names)}
    rest = groups.column("rest").to_numpy(zero_copy_only=False).astype(np.int64)
    terms, term_no = np.unique(shares.column("term").to_numpy(zero_copy_only=False), return_inverse=True)
    source_no = np.array([where[s] for s in shares.column("source").to_pylist()], np.int64)
    table = np.tile(rest, (len(terms), 1))
    table[term_no, source_no] = shares.column("p").to_numpy().astype(np.int64)
    out = []
    for a, name in enumerate(names):
        total = np.abs(table - table[:, a:a + 1]).sum(axis=0)
        keep = np.arange(len(names)) != a
        out.append(pa.Table.from_arrays([
            pa.array([groups.column("of_lang")[0].as_py()] * (len(names) - 1)), pa.array([name] * (len(names) - 1)),
            pa.array([n for n in names if n != name]), pa.array(total[keep], pa.int64())], schema=schema))
    return pa.concat_tables(out)


def divergence(counts: DataFrame, groups: DataFrame, top: int = 50) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` from :func:`term_counts`.

    Part ``pair``: each other source of the language, by the summed difference of shares.
    Part ``term``: the ``top`` terms whose share is furthest above the language's.
    """
    in_lang = counts.groupBy("lang", "term").agg(F.sum("count").alias("n"))
    langs = in_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    n_sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    zero = F.lit(0).cast("long")
    stats = staged(
        groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(n_sources, "lang")
        .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"),
                F.coalesce("lang_total", zero).alias("lang_total"),
                (F.floor(F.coalesce("terms", zero) * F.col("n_sources") / F.lit(CELLS)) + 1).alias("slices")),
        "divergence-stats")

    whole = Window.partitionBy("lang", "term")
    shares = (counts.withColumn("lang_count", F.sum("count").over(whole)).join(stats, ["lang", "source"])
              .withColumn("p", share(F.col("count"), F.col("total"), F.col("terms")))
              .withColumn("q", share(F.col("lang_count"), F.col("lang_total"), F.col("terms")))
              .withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices"))))

    with_terms = (stats.where(F.col("terms") > 0)
                  .withColumn("rest", share(F.lit(0), F.col("total"), F.col("terms")))
                  .select(F.col("lang").alias("of_lang"), F.col("source"), "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("of_slice")))
    gaps = (shares.select("lang", "slice", "source", "term", "p").groupBy("lang", "slice")
            .cogroup(with_terms.groupBy("of_lang", "of_slice")).applyInArrow(_gaps, _GAPS))
    # a language without kept terms: all differences are 0
    bare = stats.where(F.col("terms") == 0).select("lang", "source")
    others = bare.select("lang", F.col("source").alias("other"))
    bare = (bare.join(others, "lang").where(F.col("source") != F.col("other"))
            .select("lang", "source", "other", F.lit(0).cast("long").alias("gap")))
    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = (gaps.unionByName(bare).groupBy("lang", "source", F.col("other").alias("item"))
             .agg(F.sum("gap").alias("value"))
             .withColumn("rank", F.row_number().over(group))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))
    terms = (shares.where(F.col("p") > F.col("q"))
             .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top)
             .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    return pairs.unionByName(terms)


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, **columns) -> DataFrame:
    """Divergence of every (language, source) group of ``docs``."""
    return divergence(*term_counts(docs, min_docs, **columns), top)

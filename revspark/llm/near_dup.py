"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are linked if the Jaccard similarity of their sets of five-word shingles is
at least 0.8. Texts with the same words are one class and compared once. Each class
has a MinHash signature; bands of it put similar classes into common buckets. Inside
a bucket the signatures of each pair are compared piece by piece, and a pair is
dropped as soon as the posterior probability that its similarity reaches the
threshold falls below ``TOLERANCE`` (uniform prior). What survives is joined to
candidate groups, whose members' shingle sets are then compared exactly.

No pair leaves a task: a bucket or group yields a spanning forest (one edge a
member at most) and link counts per member. Buckets and groups larger than
``BLOCK`` are cut into blocks, each pair of blocks being a task of its own, so
groups of any size spread over the cluster and lose no link.

The chance that 32 bands of 4 values miss a pair of similarity 0.8 is 5e-8.

Defined results: words are lower-cased runs of word characters. A text of fewer than
five words has one shingle, all its words; a text without words (null, empty, signs
only) is linked to nothing, and is a class of its own. Repeated rows are documents
that link to their copies; null ids link like others. An empty table gives no rows.
Only id and text are read by the join.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import release, staged

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
STEP = 16  # values compared at a time
BLOCK = 512
CACHE_WORDS = 300_000

TOKEN = re.compile(r"\w+")
_RNG = np.random.default_rng(6)
_FACTOR = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[str], known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word 5-grams (of all words, if fewer)."""
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(words))
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(words) - n + 1 + i])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values, their low 16 bits."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 1024):
        part = s[at:at + 1024, None] * _FACTOR[None, :] + _SHIFT[None, :]
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(20) & np.uint64(0xFFFF)).astype("<u2")


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest of ``n`` equal values at which P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior that posterior tail is P(Binomial(n + 1, threshold) <= matches).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


_NEEDED = [(n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def surviving_pairs(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs (i, j) of rows of ``sig`` that no step drops."""
    matches = np.zeros(len(i), dtype=np.int32)
    for n, needed in _NEEDED:
        piece = np.ascontiguousarray(sig[:, n - STEP:n])
        matches = matches + (piece[i] == piece[j]).sum(axis=1, dtype=np.int32)
        keep = matches >= needed
        if not keep.all():
            i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            break
    return i, j


class Forest:
    """Union-find that remembers the joins that mattered."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join_all(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            ra, rb = self.root(a), self.root(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)

    def edges(self) -> list[tuple[int, int]]:
        """(root, member) of every member that is not its own root."""
        return [(self.root(i), i) for i in range(len(self.parent)) if self.root(i) != i]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: class key and signature of each text; no key without words."""
    known = WordHashes()
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            keys, sigs = [], []
            for text in part.column("text").to_pylist():
                words = TOKEN.findall((text or "").lower())
                if words:
                    keys.append(hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest())
                    sigs.append(signature(shingles(words, known)).tobytes())
                else:
                    keys.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("th"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "th", "key", "sig"])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by column ``g`` as one table per batch that ends where a group ends."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        g = t.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1], side="left"))
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None:
        yield rest


def _starts(g: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])


def _pairs(start: int, end: int, side: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one group: all of one block, or those between its two blocks."""
    if diagonal:
        i, j = np.triu_indices(end - start, 1)
        return i + start, j + start
    own, other = start + np.flatnonzero(side[start:end] == 0), start + np.flatnonzero(side[start:end])
    return np.repeat(own, len(other)), np.tile(other, len(own))


def _bucket_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: spanning forest over the surviving pairs of each bucket (or pair of its blocks)."""
    for t in whole_groups(batches):
        g, side = t.column("g").to_numpy(), t.column("side").to_numpy()
        diagonal = t.column("diagonal").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype="<u2").reshape(len(g), HASHES)
        forest = Forest(len(g))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        bounds = _starts(g)
        for start, end in zip(bounds[:-1], bounds[1:]):
            waiting.append(_pairs(start, end, side, diagonal[start]))
            size += len(waiting[-1][0])
            if size > 100_000:
                forest.join_all(*surviving_pairs(sig, *(np.concatenate(x) for x in zip(*waiting))))
                waiting, size = [], 0
        if waiting:
            forest.join_all(*surviving_pairs(sig, *(np.concatenate(x) for x in zip(*waiting))))
        edges = forest.edges()
        keys = t.column("key")
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array([e[k] for e in edges], pa.int64())).combine_chunks().cast(pa.binary()) for k in (0, 1)], names=["a", "b"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products over the hashes that several sets hold."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    column = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]))
    several = np.bincount(column)[column] > 1
    column, owner = column[several], owner[several]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    if not len(column):
        return total
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    for at in range(0, int(column[-1]) + 1, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        total += m @ m.T
    return total


def _exact_links(keys: list[bytes], texts: list[str], copies: np.ndarray, side: np.ndarray, diagonal: bool,
                 known: WordHashes) -> tuple[list[tuple[bytes, bytes]], list[tuple[bytes, int]]]:
    """Spanning forest and, per member, documents linked, of one group or two of its blocks."""
    sets = [shingles(TOKEN.findall(t.lower()), known) for t in texts]
    sizes = np.array([len(x) for x in sets], dtype=np.float64)
    shared = shared_counts(sets)
    # shared / union >= 4 / 5, in whole numbers
    linked = shared * 5 >= (sizes[:, None] + sizes[None, :] - shared) * 4
    np.fill_diagonal(linked, False)
    if not diagonal:
        linked &= side[:, None] != side[None, :]
    forest = Forest(len(keys))
    forest.join_all(*np.nonzero(np.triu(linked)))
    links = linked @ copies
    return ([(keys[p], keys[q]) for p, q in forest.edges()], [(keys[k], int(links[k])) for k in np.flatnonzero(links)])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: exact links of each candidate group (or pair of its blocks).

    Rows: (a, b) edges of a spanning forest, and (a, links) weighted by the copies linked.
    """
    known = WordHashes()
    for t in whole_groups(batches):
        side, diagonal, copies = (t.column(c).to_numpy() for c in ("side", "diagonal", "copies"))
        bounds = _starts(t.column("g").to_numpy())
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            part = t.slice(start, end - start)
            edges, links = _exact_links(part.column("key").to_pylist(), part.column("text").to_pylist(),
                                        copies[start:end], side[start:end], bool(diagonal[start]), known)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([p for p, _ in edges] + [k for k, _ in links], pa.binary()),
                "b": pa.array([q for _, q in edges] + [None] * len(links), pa.binary()),
                "links": pa.array([0] * len(edges) + [n for _, n in links], pa.int64())})


def in_blocks(members: DataFrame, group: list[str]) -> DataFrame:
    """Deal the members of groups of ``_m`` rows to pairs of blocks of about ``BLOCK`` rows, sorted by pair.

    A member comes once for each block of its group. ``g`` is the pair of blocks, ``side`` tells
    its two blocks apart, ``diagonal`` says that both are the same.
    """
    n = F.ceil(F.col("_m") / F.lit(BLOCK)).cast("int")
    dealt = (members.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64(F.lit(7), "key"), F.col("_n")).cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))
    return (dealt.withColumn("g", F.xxhash64(*group, F.least("_own", "_o"), F.greatest("_own", "_o")))
            .withColumn("side", (F.col("_own") > F.col("_o")).cast("int"))
            .withColumn("diagonal", F.col("_own") == F.col("_o"))
            .drop("_m", "_n", "_own", "_o", *group)
            .repartition("g").sortWithinPartitions("g", "key"))


def _stars(edges: DataFrame) -> bool:
    ends = (edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root"))
            .unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root"))))
    return (ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
            .where("up > 1 OR (up = 1 AND root = 1)").isEmpty())


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node of the edges (a, b); the root is the least key.

    Alternates large-star and small-star steps, each written out, until the edges are stars: no node
    has two edges up, and none that has one is another's root.
    """
    current = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .distinct(), "cc")
    while not _stars(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = staged(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .where("a <> b").distinct(), "cc")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        release(large)
        release(current)
        current = new
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def link_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"):
    """Classes and links of all documents.

    Returns (rows, classes). ``rows``: one per document, ``doc_id``, ``th`` (hash of its text), ``key`` (null without
    words). ``classes``: one per key, ``rep_id`` (least id), ``rep_th``, ``copies``, ``links`` (documents in other
    classes linked to it), ``root`` (key of its group), ``class_id`` (least id of its group).
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("th", F.xxhash64(F.lit(1), "text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = staged(source.mapInArrow(_signed, f"doc_id {kind}, th long, key binary, sig binary"), "signed")

    classes = staged(rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "th")).alias("rep"),
        F.min("sig").alias("sig")), "classes")

    values = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                         lambda i: F.struct(i.alias("band"), F.substring(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)).alias("value")))
    bands = classes.select("key", F.explode(values).alias("v")).select("key", "v.band", "v.value")
    shared = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    members = staged(bands.join(shared, ["band", "value"]), "members").join(classes.select("key", "sig"), "key")
    forest = in_blocks(members, ["band", "value"]).mapInArrow(_bucket_forests, "a binary, b binary")
    groups = staged(components(forest), "groups")

    inside = (groups.join(classes.select(F.col("key").alias("node"), "copies", "rep"), "node")
              .select(F.col("node").alias("key"), "root", "copies", F.col("rep.doc_id").alias("doc_id"),
                      F.col("rep.th").alias("th")))
    # one text per class: its representative's, found by id and text hash
    match = [inside["doc_id"].eqNullSafe(source["doc_id"]), inside["th"] == source["th"]]
    texts = inside.join(source, match).select("key", "root", "copies", "text").dropDuplicates(["key"])
    texts = texts.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("_m")), "root")
    links = staged(in_blocks(texts, ["root"]).mapInArrow(_verified, "a binary, b binary, links long"), "links")

    final = components(links.where(F.col("b").isNotNull()).select("a", "b"))
    counts = links.where(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    classes = (classes.join(final.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left")
               .select("key", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"),
                       F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    classes = staged(classes, "linked")
    least = classes.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    return rows.select("doc_id", "th", "key"), classes.join(least, "root")


def linked_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (least id of its group) and ``n_links`` (documents linked)."""
    rows, classes = link_documents(docs, id_col=id_col, text_col=text_col)
    total = F.col("links") + F.col("copies") - 1
    found = rows.join(classes.select("key", "class_id", total.alias("n_links")), "key", "left")
    return found.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _id_key(column):
    return F.coalesce(column.cast("string"), F.lit("~"))


def keep_one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group: the one of the least id (of fully repeated rows, one).

    Documents without words are kept, every copy; what has words is decided by the join's own rows.
    """
    signed, classes = link_documents(docs, id_col=id_col, text_col=text_col)
    first = F.min(F.struct(F.col("rep_id").isNull().alias("nul"), "rep_id", "rep_th"))
    keep = (classes.groupBy("root").agg(first.alias("k"))
            .select(_id_key(F.col("k.rep_id")).alias("ik"), F.col("k.rep_th").alias("th")))
    wordless = signed.where(F.col("key").isNull()).select(_id_key(F.col("doc_id")).alias("ik"), "th")
    rows = docs.select(F.struct("*").alias("row"), _id_key(F.col(id_col)).alias("ik"),
                       F.col(text_col).cast("string").alias("text"))
    some = F.coalesce(F.col("text") != "", F.lit(False))
    hashed = rows.where(some).select("row", "ik", "text", F.xxhash64(F.lit(1), "text").alias("th"))
    # the grouping follows the join's partitioning; it drops the repeats of a repeated row
    one = (hashed.select("row", "ik", "th").join(keep, ["ik", "th"], "left_semi")
           .groupBy("ik", "th").agg(F.first("row").alias("row")))
    # these letters are words by any rule: such texts need not be looked up
    signs = hashed.where(~F.col("text").rlike("[0-9A-Za-z_]")).join(wordless, ["ik", "th"], "left_semi")
    both = one.select("row").unionByName(signs.select("row")).unionByName(rows.where(~some).select("row"))
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

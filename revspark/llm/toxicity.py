"""Toxicity: a learned lexicon, matched through spelling errors, scored in context.

Lexicon: words (and word beginnings shared by many words) that labelled toxic
documents use and clean ones do not, each in several contexts, so that copies of one
document cannot make a term. Terms form a trie. A word's Levenshtein automaton
is intersected with the trie, which finds the terms within one edit (two from
eight letters on) without listing variants; variants that clean labelled
documents use are words of their own and left out.

Every occurrence is weighted by its context window: inside quotation marks or near
words of reporting it counts as quotation, near words of address as abuse. A
logistic fit over the weighted evidence gives the score.

Bounds of the model: at most ``MAX_LABELLED`` labelled documents (by hash), at most
``MAX_TERMS`` terms and as many exceptions. Scoring reads every whole text.

Defined results: null and empty texts score as texts without evidence; rows
without label, with null id, or repeated, are scored like any; without any labelled
toxic document the lexicon is empty and all scores are 0; an empty table gives no
rows; only the columns named are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import held_out, staged
from revspark.llm.logistic import fit_logistic

MAX_LABELLED = 20_000
MAX_TERMS = 2_000
MIN_DOCS = 8
MIN_CONTEXTS = 8
MIN_SHARE = 0.5
STEMS = (4, 5, 6, 7)
CACHE_WORDS = 300_000
WINDOW = 6
#: Weight of one edit, of quotation (marks or reporting words; both), of address.
EDIT, QUOTED, QUOTED_TWICE, ADDRESSED = 0.7, 0.5, 0.2, 1.25

WORD = re.compile(r"\w+(?:[@$*]\w+)*")
#: A quotation mark and those that close it, within the line.
CLOSES = {'"': '"', "“": "”", "«": "»", "„": "“”"}
QUOTE_MARK = re.compile('["“”«»„\\n]')
REPORTING = frozenset("said says say quote quoted quotes called calls term word words wrote writes slur reported "
                      "dijo dice palabra dit mot sagte sagt wort zitat".split())
ADDRESS = frozenset("you your youre ur u du dich dein sie tu vous toi te usted tú".split())


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotations, in order, marks included, however long. None crosses a line's end.

    A mark without a closing one in its line opens nothing, nor does any later one of its kind there.
    """
    marks = [(m.start(), m.group()) for m in QUOTE_MARK.finditer(text)]
    out, i, lacking = [], 0, set()
    while i < len(marks):
        start, mark = marks[i]
        if mark == "\n":
            lacking.clear()
        if mark in CLOSES and mark not in lacking:
            j = i + 1
            if j < len(marks) and marks[j][1] in CLOSES[mark] and marks[j][0] == start + 1:  # nothing between
                i += 1
                continue
            while j < len(marks) and marks[j][1] != "\n" and marks[j][1] not in CLOSES[mark]:
                j += 1
            if j < len(marks) and marks[j][1] != "\n":
                out.append((start, marks[j][0] + 1))
                i = j
            else:
                lacking.add(mark)
        i += 1
    return out


class Trie:
    __slots__ = ("next", "weight", "stem")

    def __init__(self):
        self.next: dict[str, Trie] = {}
        self.weight: float | None = None  # of the term that ends here
        self.stem: float | None = None  # of the word beginning that ends here

    def put(self, term: str, weight: float, stem: bool = False) -> None:
        node = self
        for ch in term:
            node = node.next.setdefault(ch, Trie())
        if stem:
            node.stem = weight
        else:
            node.weight = weight


class LevenshteinAutomaton:
    """Accepts what is at most ``k`` edits from ``word``.

    A state holds, as (letters of the word read, edits made), every way to have read the
    input so far; ways that another one is at least as good as are left out.
    """

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> set[tuple[int, int]]:
        return {(0, 0)}

    def step(self, state: set[tuple[int, int]], ch: str) -> set[tuple[int, int]]:
        word, k, n = self.word, self.k, len(self.word)
        out = set()
        for i, e in state:
            if i < n and word[i] == ch:
                out.add((i + 1, e))
                continue  # no edit here is ever better
            if e < k:
                out.add((i, e + 1))
                if i < n:
                    out.add((i + 1, e + 1))
                at = word.find(ch, i + 1, i + 1 + k - e)
                if at >= 0:
                    out.add((at + 1, e + at - i))
        if len(out) > 1:
            out = {(i, e) for i, e in out if not any(f < e and abs(i - j) <= e - f for j, f in out)}
        return out

    def distance(self, state: set[tuple[int, int]]) -> int:
        """Edits if the input ends here; over ``k`` if it is not accepted."""
        n = len(self.word)
        return min((e + n - i for i, e in state), default=self.k + 1)


def allowed_edits(n: int) -> int:
    return 0 if n < 5 else 1 if n < 8 else 2


def nearest_term(trie: Trie, word: str) -> tuple[float, int] | None:
    """(weight, edits) of the nearest term, the heaviest among equals; None if none is near."""
    node, best = trie, None
    for ch in word:  # exact walk: the word itself, or a beginning of it
        node = node.next.get(ch)
        if node is None:
            break
        if node.stem is not None:
            best = (node.stem, 0)
    else:
        if node.weight is not None:
            return node.weight, 0
    k = allowed_edits(len(word))
    if best or not k:
        return best
    automaton = LevenshteinAutomaton(word, k)
    todo = [(trie, automaton.start(), 0)]
    while todo:
        node, state, depth = todo.pop()
        if node.weight is not None:
            d = automaton.distance(state)
            # the term, too, must be long enough for that many edits
            if 0 < d <= min(k, allowed_edits(depth)) and (best is None or (d, -node.weight) < (best[1], -best[0])):
                best = (node.weight, d)
        for ch, child in node.next.items():
            new = automaton.step(state, ch)
            if new:
                todo.append((child, new, depth + 1))
    return best


class Pieces:
    """Tells which words can be near a term at all: of k + 1 pieces of a term one survives k edits,
    moved by k letters at most."""

    def __init__(self, terms):
        self.by_length: dict[int, dict[tuple[int, int], set[str]]] = {}
        for term in terms:
            n, k = len(term), allowed_edits(len(term))
            cuts = [n * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]) if k else ():
                for length in range(n - k, n + k + 1):
                    for at in range(max(0, a - k), min(a + k, length - (b - a)) + 1):
                        self.by_length.setdefault(length, {}).setdefault((at, at + b - a), set()).add(term[a:b])

    def possible(self, word: str) -> bool:
        return any(word[a:b] in pieces for (a, b), pieces in self.by_length.get(len(word), {}).items())


@dataclass
class Lexicon:
    """Terms and word beginnings with weights, and near words that are none of them."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()


class Scanner:
    """Evidence of one text; remembers words already looked up."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.trie, self.pieces = lexicon, Trie(), Pieces(lexicon.terms)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}
        for t, w in lexicon.terms.items():
            self.trie.put(t, w)
        for t, w in lexicon.stems.items():
            self.trie.put(t, w, stem=True)
        self.starts = {t[:3] for t in [*lexicon.terms, *lexicon.stems]}

    def look_up(self, word: str) -> tuple[float, int] | None:
        if word[:3] not in self.starts and not self.pieces.possible(word):
            return None
        hit = nearest_term(self.trie, word)
        return None if hit and hit[1] and word in self.lexicon.exceptions else hit

    def __call__(self, text: str) -> tuple[list[float], list[str]]:
        """Features (evidence, strongest hit, density) and the misspelled words met."""
        low = text.lower()
        words = WORD.findall(low)
        distinct = set(words)
        if len(self.clean) > CACHE_WORDS:
            self.clean.clear()
        if len(self.hits) > CACHE_WORDS:
            self.hits.clear()
        for w in distinct - self.clean:
            if w not in self.hits:
                hit = self.look_up(w)
                if hit:
                    self.hits[w] = hit
                else:
                    self.clean.add(w)
        if self.hits.keys().isdisjoint(distinct):
            return [0.0, 0.0, 0.0], []
        quoted = quotations(low)
        at = 0
        total = strongest = 0.0
        near = []
        for i, m in enumerate(WORD.finditer(low)):
            hit = self.hits.get(m.group())
            if not hit:
                continue
            around = words[max(0, i - WINDOW):i] + words[i + 1:i + 1 + WINDOW]
            while at < len(quoted) and quoted[at][1] <= m.start():
                at += 1
            marks = at < len(quoted) and quoted[at][0] < m.start() and m.end() < quoted[at][1]
            told = not REPORTING.isdisjoint(around)
            weight = hit[0] * EDIT ** hit[1]
            if marks or told:
                weight *= QUOTED_TWICE if marks and told else QUOTED
            elif not ADDRESS.isdisjoint(around):
                weight *= ADDRESSED
            total += weight
            strongest = max(strongest, weight)
            if hit[1]:
                near.append(m.group())
        return [math.log1p(total), strongest, math.log1p(100 * total / len(words))], near


@dataclass
class Model:
    lexicon: Lexicon
    coef: list[float]
    base: float


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int = MAX_LABELLED,
                    columns: tuple[str, ...] = ()) -> DataFrame:
    """(``text``, ``y``, ``columns``) of about ``bound`` labelled documents outside the held-out fifth, by hash.

    Of the rows that repeat an id one is taken, the first by hash of its content, so the bound holds for rows.
    """
    known = (labels.where(F.col(label).isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")))
    n = known.count()
    if n > bound:
        share = bound / n
        known = known.where(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = F.broadcast(known)  # bounded by `bound`
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *columns).join(picked, "doc_id")
    # rows that tie on the hash are alike; partial aggregates keep an id that holds most rows small
    first = F.min(F.struct(F.xxhash64(F.lit(2), "text", *columns).alias("h"), "text", "y", *columns))
    return rows.groupBy("doc_id").agg(first.alias("r")).select("r.text", "r.y", *[f"r.{c}" for c in columns])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: documents, toxic documents and a 64-bit set of contexts for every word and beginning."""
    n, tox, contexts = Counter(), Counter(), {}

    def flush():
        keys = list(n)
        out = pa.RecordBatch.from_pydict({
            "term": pa.array([k[0] for k in keys], pa.string()), "stem": pa.array([k[1] for k in keys], pa.bool_()),
            "n": pa.array([n[k] for k in keys], pa.int64()), "tox": pa.array([tox[k] for k in keys], pa.int64()),
            "ctx": pa.array([contexts.get(k, 0) for k in keys], pa.uint64()).cast(pa.int64(), safe=False)})
        n.clear(), tox.clear(), contexts.clear()
        return out

    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = WORD.findall((text or "").lower())
            distinct = set(words)
            keys = {(w, False) for w in distinct if len(w) > 2}
            keys |= {(w[:i], True) for w in distinct for i in STEMS if len(w) > i}
            n.update(keys)
            if y:
                tox.update(keys)
                for before, w in zip([""] + words, words):
                    k = (w, False)
                    contexts[k] = contexts.get(k, 0) | 1 << (zlib.crc32(before.encode()) & 63)
                    for i in STEMS:
                        if len(w) > i:
                            k = (w[:i], True)
                            contexts[k] = contexts.get(k, 0) | 1 << (zlib.crc32(w.encode()) & 63)
            if len(n) > 400_000:
                yield flush()
    yield flush()


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms and beginnings that toxic documents use in many contexts and clean ones hardly."""
    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("tox")).first()
    if not sizes["tox"] or sizes["tox"] == sizes["n"]:
        return Lexicon()
    counts = (sample.mapInArrow(_term_counts, "term string, stem boolean, n long, tox long, ctx long")
              .groupBy("term", "stem").agg(F.sum("n").alias("n"), F.sum("tox").alias("tox"),
                                           F.bit_or("ctx").alias("ctx")))
    good = counts.where((F.col("tox") >= MIN_DOCS) & (F.col("tox") >= F.col("n") * MIN_SHARE)
                        & (F.bit_count("ctx") >= MIN_CONTEXTS))
    rows = good.orderBy(F.col("tox").desc(), "term", "stem").limit(MAX_TERMS).collect()
    clean = sizes["n"] - sizes["tox"]

    def weight(r):
        return math.log((r["tox"] + .5) / (sizes["tox"] + 1) * (clean + 1) / (r["n"] - r["tox"] + .5))

    stems: dict[str, float] = {}
    words = {r["term"]: weight(r) for r in rows if not r["stem"]}
    for r in sorted((r for r in rows if r["stem"]), key=lambda r: (len(r["term"]), r["term"])):
        t = r["term"]
        covered = any(t.startswith(s) for s in stems)
        if not covered and r["tox"] >= 0.9 * r["n"]:
            stems[t] = weight(r)
    # terms that a stem covers stay: a stem is matched as it is written, a term through its misspellings too
    return Lexicon(words, stems)


def _evidence(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(lexicon)
        for b in batches:
            got = [scan(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.float64())), b.column(1),
                                              pa.array([sorted(set(g[1])) for g in got], pa.list_(pa.string()))],
                                             names=["x", "y", "near"])
    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = MAX_LABELLED) -> Model:
    """Fit lexicon, exceptions and score on the labelled documents outside the held-out fifth."""
    sample = staged(labelled_sample(docs, labels, label, bound), "labelled")
    sample = sample.repartition(max(1, min(200, sample.sparkSession.sparkContext.defaultParallelism)))
    lexicon = learn_lexicon(sample)
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).first()
    base = (total["t"] or 0) / max(1, total["n"])
    if not lexicon.terms and not lexicon.stems:
        return Model(lexicon, [0.0, 0.0, 0.0, -40.0 if not total["t"] else math.log(max(base, 1e-9) / max(1 - base, 1e-9))], base)
    seen = sample.mapInArrow(_evidence(lexicon), "x array<double>, y int, near array<string>")
    known = (seen.select("y", F.explode("near").alias("w")).groupBy("w")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).where("t < n * 0.5")
             .orderBy(F.col("n").desc(), "w").limit(MAX_TERMS).collect())
    lexicon.exceptions = frozenset(r["w"] for r in known)
    rows = sample.mapInArrow(_evidence(lexicon), "x array<double>, y int, near array<string>").select("x", "y").collect()
    coef = fit_logistic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=float))
    return Model(lexicon, coef.tolist(), base)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of ``keep``, default all columns) and ``score`` of every document."""
    rows = docs.select(F.struct(*[F.col(c) for c in (keep or docs.columns)]).alias("row"),
                       F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, coef = Scanner(model.lexicon), np.array(model.coef)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = np.array([scan(t or "")[0] + [1.0] for t in part.column(1).to_pylist()]).reshape(-1, 4)
                s = 1 / (1 + np.exp(-np.clip(x @ coef, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, f"row {kind}, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, unchanged."""
    scored = score(docs, train(docs, labels))
    return scored.where("score < 0.5").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

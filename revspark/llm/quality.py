"""Quality classifier by co-training of two views.

One classifier sees only the text (repetition, word shapes, signs), the other only
the document's metadata (language, source, length). Starting from the labelled
documents, in every round each gives pseudo-labels to the unlabelled documents it is
surest of, in the proportion of the classes, and the other learns from them. At the
end each view is calibrated on labelled documents kept out of its training, and a
logistic combination of the calibrated views scores every document.

Both views are additive: each feature is cut at sample quantiles, each interval has a
weight. Bounds of the model: ``MAX_LABELLED`` labelled and ``MAX_UNLABELLED``
unlabelled documents, both by hash. Scoring reads every whole text.

Defined results: null and empty texts have all text features 0; null language or
source is a value of its own, a null length counts as 0; documents without label,
with null id, or repeated, are scored like any; without labels of both classes every
score is the share of the better class (0.5 without labels); an empty table
gives no rows; only the columns named are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import staged
from revspark.llm.logistic import fit_logistic, sigmoid
from revspark.llm.toxicity import labelled_sample

MAX_LABELLED = 20_000
MAX_UNLABELLED = 20_000
ROUNDS = 5
#: Pseudo-labels a view gives per round, and the least confidence for one.
PER_ROUND, CONFIDENT = 1_000, 0.95
BINS = 12
LANGS, SOURCES = 8, 32
SIGN = re.compile(r"[^\w\s]")
META = ("lang", "source", "n_chars")


def text_features(text: str) -> list[float]:
    """Numbers about the whole text alone."""
    words = text.split()
    if not words:
        return [0.0] * 12
    n, low = len(words), Counter(w.lower() for w in words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text))
    return [math.log1p(n), len(low) / n, low.most_common(1)[0][1] / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            letters / n, sum(map(str.isupper, text)) / max(1, letters), len(SIGN.findall(text)) / n,
            sum(map(str.isdigit, text)) / n, sum(len(w) <= 3 for w in words) / n,
            1 - len(set(lines)) / len(lines), text.count("|") / n, sum(w[-1] in ".!?" for w in words) / n]


def meta_features(lang, source, n_chars) -> list[float]:
    """Numbers about the metadata alone: length, then which hashed language and source."""
    n = math.log1p(max(0, n_chars or 0))
    out = [0.0] * (LANGS + SOURCES)
    out[zlib.crc32(f"lang {lang}".encode()) % LANGS] = 1.0
    out[LANGS + zlib.crc32(f"source {source}".encode()) % SOURCES] = 1.0
    return [n, *out]


@dataclass
class View:
    """Additive logistic model over binned features."""

    edges: list[np.ndarray]
    coef: np.ndarray | None = None

    @classmethod
    def over(cls, x: np.ndarray) -> View:
        return cls([np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T])

    def spread(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for col, e in zip(x.T, self.edges):
            at = np.searchsorted(e, col, side="right")
            parts.append(np.eye(len(e) + 1)[at][:, 1:])
        return np.hstack(parts)

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.coef = fit_logistic(self.spread(x), y, ridge=2.0)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x) @ self.coef[:-1] + self.coef[-1]


@dataclass
class Model:
    base: float
    text: View | None = None
    meta: View | None = None
    calibration: tuple[np.ndarray, np.ndarray] | None = None  # of text, of meta: slope, shift
    combine: np.ndarray | None = None

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, text view, metadata view), calibrated."""
        if self.text is None:
            flat = np.full(len(xt), self.base)
            return flat, flat, flat
        (a, b), (c, d) = self.calibration
        zt, zm = a * self.text.logit(xt) + b, c * self.meta.logit(xm) + d
        w = self.combine
        return sigmoid(w[0] * zt + w[1] * zm + w[2]), sigmoid(zt), sigmoid(zm)


def _surest(p: np.ndarray, free: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Unlabelled rows a view is surest of, and its labels, in the proportion of the classes."""
    up, down = max(1, round(PER_ROUND * share)), max(1, round(PER_ROUND * (1 - share)))
    rows = np.flatnonzero(free)
    order = rows[np.argsort(p[rows], kind="stable")]
    bad = [i for i in order[:down] if p[i] <= 1 - CONFIDENT]
    good = [i for i in order[::-1][:up] if p[i] >= CONFIDENT]
    return np.array(bad + good, dtype=int), np.array([0.0] * len(bad) + [1.0] * len(good))


def co_train(xt, xm, y, ut, um, rounds: int = ROUNDS) -> Model:
    """Model from labelled (xt, xm, y) and unlabelled (ut, um) features."""
    base = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or base in (0.0, 1.0):
        return Model(base)
    apart = np.arange(len(y)) % 4 == 0  # labelled rows kept for calibration
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        return Model(base)
    text, meta = View.over(np.vstack([xt, ut])), View.over(np.vstack([xm, um]))
    given = {"text": ([xt[~apart]], [y[~apart]]), "meta": ([xm[~apart]], [y[~apart]])}
    free = {"text": np.ones(len(ut), dtype=bool), "meta": np.ones(len(ut), dtype=bool)}
    for r in range(rounds + 1):
        text.fit(np.vstack(given["text"][0]), np.concatenate(given["text"][1]))
        meta.fit(np.vstack(given["meta"][0]), np.concatenate(given["meta"][1]))
        if r == rounds or not len(ut):
            break
        for teacher, pupil, p, own in (("text", "meta", sigmoid(text.logit(ut)), um),
                                       ("meta", "text", sigmoid(meta.logit(um)), ut)):
            rows, labels = _surest(p, free[teacher], base)
            free[teacher][rows] = False
            if len(rows):
                given[pupil][0].append(own[rows])
                given[pupil][1].append(labels)
    zt, zm = text.logit(xt[apart]), meta.logit(xm[apart])
    ct, cm = fit_logistic(zt[:, None], y[apart], 0.1), fit_logistic(zm[:, None], y[apart], 0.1)
    both = np.stack([ct[0] * zt + ct[1], cm[0] * zm + cm[1]], axis=1)
    return Model(base, text, meta, (ct, cm), fit_logistic(both, y[apart], 0.1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t, m = [], []
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            t += [text_features(x or "") for x in part.column("text").to_pylist()]
            m += [meta_features(*x) for x in zip(*[part.column(c).to_pylist() for c in META])]
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(t, kind), pa.array(m, kind)],
                                         names=["h", "y", "t", "m"])


def _typed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"),
                             "n_chars": F.col("n_chars").cast("long")})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Co-train on labelled documents outside the held-out fifth and a sample of all documents."""
    docs = _typed(docs.select("doc_id", "text", *META))
    known = labelled_sample(docs, labels, label, MAX_LABELLED, META)
    n = docs.count()
    rest = docs.where(F.pmod(F.xxhash64(F.lit(10), "doc_id", "text"), F.lit(1 << 30))
                      < int(min(1.0, MAX_UNLABELLED / max(1, n)) * (1 << 30)))
    # repeats of an id and text share the hash: one of them is taken
    rest = rest.groupBy("doc_id", "text").agg(F.min(F.struct(*META)).alias("r")).select("text", *[f"r.{c}" for c in META])
    both = (known.select("text", "y", *META)
            .unionByName(rest.select(F.col("text").cast("string").alias("text"), F.lit(-1).alias("y"), *META)))
    both = staged(both.withColumn("h", F.xxhash64("text", *META)), "quality-sample")
    width = both.sparkSession.sparkContext.defaultParallelism
    got = (both.repartition(max(1, min(200, width))).mapInArrow(_features, "h long, y int, t array<double>, m array<double>")
           .orderBy("h", "y").collect())  # bounded by the two sample sizes

    def block(rows, key, width):
        return np.array([r[key] for r in rows], dtype=float).reshape(-1, width)

    lab, unl = [r for r in got if r["y"] >= 0], [r for r in got if r["y"] < 0]
    wt, wm = 12, 1 + LANGS + SOURCES
    return co_train(block(lab, "t", wt), block(lab, "m", wm), np.array([r["y"] for r in lab], dtype=float),
                    block(unl, "t", wt), block(unl, "m", wm))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of ``keep``, default all columns), ``score``, ``text_score``, ``meta_score``."""
    rows = docs.select(F.struct(*[F.col(c) for c in (keep or docs.columns)]).alias("row"),
                       F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                t = np.array([text_features(x or "") for x in part.column("text").to_pylist()])
                m = np.array([meta_features(*x) for x in zip(*[part.column(c).to_pylist() for c in META])])
                s = model.scores(t, m)
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(x, pa.float64()) for x in s]],
                                                 names=["row", "score", "text_score", "meta_score"])

    return rows.mapInArrow(run, f"row {kind}, score double, text_score double, meta_score double")

"""Secret scans: fixed patterns plus sliding-window entropy.

Three patterns give the base spans. Beyond them, every long run of token
characters is a candidate; inside it a window slides over the runs of each
character class (hexadecimal, base 64, letters of one case with digits), and the
Shannon entropy of the window is kept up to date from the counts of the character
that leaves and the one that enters. Windows over their class's threshold are joined
to ``entropy`` spans, unless the allow list knows them: a window that touches a
placeholder, an alphabet or a UUID is none, nor is a span that a base span overlaps. A
window also needs the mix of its class: 3 digits and a letter (hexadecimal); 2 digits and
letters of both cases (base 64); two runs of digits between letters (one case). Pieces
of one case between separators are read as one run; as words and paths look like that
too, a window of it needs four runs of digits that have letters on both sides in their
piece. Tokens without digits are words and give no span. The time is linear in the text.

Spans are in code points, end exclusive, over the whole text. Defined results:
null and empty texts have no spans; null ids and repeated rows are scanned like
any row; an empty table gives no rows; only the columns named are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run too short fails from every start inside it
HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGNED = 12

#: Runs of token characters worth a look.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character class: runs it covers, window length, least bits per character.
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 3.0),
           ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.7),
           ("lower", re.compile(r"[a-z0-9]{20,}"), 20, 3.4),
           ("upper", re.compile(r"[A-Z0-9]{20,}"), 20, 3.4))
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Parts of a candidate that no window may touch.
MARKS = re.compile(r"example|placeholder|changeme|x{6,}|0123456789|abcdefghij"
                   r"|(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])", re.IGNORECASE)
#: Pieces of one case between separators, read as one run without them: words with digits beside
#: them are no token, digits between letters are. Digit runs inside pieces, at least.
PARTED = (re.compile(r"(?<![a-z0-9])[a-z0-9]++(?:[/_-]++[a-z0-9]++)+"),
          re.compile(r"(?<![A-Z0-9])[A-Z0-9]++(?:[/_-]++[A-Z0-9]++)+"))
PARTED_BITS, PARTED_INNER = 3.4, 4

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, sorted."""
    out = []
    low = text.lower()
    if ("=" in low or ":" in low) and any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def window_entropies(run: str, width: int) -> Iterator[float]:
    """Shannon entropy of each window of ``width`` characters, by incremental counts."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c)

    def moved(c: int) -> float:
        return c * math.log2(c) if c > 1 else 0.0

    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += moved(c + 1) - moved(c)
        counts[ch] = c + 1
        if i >= width:
            old = run[i - width]
            c = counts[old]
            total += moved(c - 1) - moved(c)
            counts[old] = c - 1
        if i >= width - 1:
            yield math.log2(width) - total / width


def _prefix(flags) -> list[int]:
    return [0, *accumulate(flags)]


def _mixes(kind: str, run: str, width: int) -> Callable[[int], bool]:
    """Does the window at a place have the mix of characters its class asks for? By prefix counts."""
    digit = [c.isdigit() for c in run]
    digits = _prefix(digit)
    if kind == "hex":
        return lambda i: 3 <= digits[i + width] - digits[i] < width
    if kind in ("lower", "upper"):
        begun = _prefix(d and not (i and digit[i - 1]) for i, d in enumerate(digit))
        return lambda i: (digits[i + width] - digits[i] < width
                          and begun[i + width] - begun[i + 1] + digit[i] >= 2)
    lower, upper = _prefix(c.islower() for c in run), _prefix(c.isupper() for c in run)
    return lambda i: (digits[i + width] - digits[i] >= 2 and lower[i + width] > lower[i] and upper[i + width] > upper[i])


def _clear(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Does a range, asked for in ascending order, touch none of the sorted spans?"""
    at = 0

    def clear(start: int, end: int) -> bool:
        nonlocal at
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        return at == len(spans) or spans[at][0] >= end
    return clear


def _parted(candidate: str, marks: list[tuple[int, int]], width: int = 20) -> Iterator[tuple[int, int]]:
    """Windows of single-case pieces read without the separators between them."""
    for pattern in PARTED:
        clear = _clear(marks)
        for m in pattern.finditer(candidate):
            places = [i for i in range(m.start(), m.end()) if candidate[i] not in "/_-"]
            if len(places) < width:
                continue
            run = "".join(candidate[i] for i in places)
            # a digit run counts where it ends, if its piece has letters on both sides of it
            inner = [0] * len(run)
            for d in re.finditer(r"(?<=[A-Za-z])[0-9]+(?=[A-Za-z])", m.group()):
                inner[bisect_left(places, m.start() + d.end() - 1)] = 1
            inner = _prefix(inner)
            for i, bits in enumerate(window_entropies(run, width)):
                a, b = places[i], places[i + width - 1] + 1
                if bits >= PARTED_BITS and inner[i + width] - inner[i] >= PARTED_INNER and clear(a, b):
                    yield a, b


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of random-looking strings, sorted and not overlapping each other."""
    found = []
    for m in CANDIDATE.finditer(text):
        candidate = m.group()
        if not (_DIGIT.search(candidate) and _LETTER.search(candidate)):
            continue  # no class finds anything in it
        marks = [x.span() for x in MARKS.finditer(candidate)]
        for kind, runs, width, least in CLASSES:
            clear = _clear(marks)
            for r in runs.finditer(candidate):
                mixed = _mixes(kind, r.group(), width)
                for i, bits in enumerate(window_entropies(r.group(), width)):
                    at = r.start() + i
                    if bits >= least and mixed(i) and clear(at, at + width):
                        found.append((m.start() + at, m.start() + at + width))
        found += [(m.start() + a, m.start() + b) for a, b in _parted(candidate, marks)]
    joined: list[list[int]] = []
    for start, end in sorted(found):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    return [(s, 3, e) for s, e in joined]


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and the entropy spans that overlap none of them."""
    base = base_spans(text)
    extra, at, reach = [], 0, 0  # reach: furthest end of the base spans that start before the span's end
    for x in entropy_spans(text):
        while at < len(base) and base[at][0] < x[2]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= x[0]:
            extra.append(x)
    return sorted(base + extra)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones joined) replaced by ``[kind]`` of its first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: array of (kind, start, end) by start, then kind as in ``KINDS``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t or "")]
                         for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, span_type)], names=[id_col, "spans"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {id_type}, spans {SPANS}")


def redact_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with every secret replaced by ``[kind]``; ``n_chars`` follows the new text."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                clean = [t if t is None else redacted(t, all_spans(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(clean, pa.string())], names=["row", "text"])

    out = rows.mapInArrow(run, rows.schema)
    changed = ~F.col("text").eqNullSafe(F.col(f"row.`{text_col}`").cast("string"))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(changed, F.length("text")).otherwise(F.col("row.n_chars"))
                        .cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*cols)

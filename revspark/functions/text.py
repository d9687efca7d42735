"""Column expressions over text and token arrays.

All but ``element_text`` (an HTML parser) build JVM-side expressions (regex, higher-order
array functions), so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from revspark.functions import constants as K

# Words (letters/digits) or one single non-space symbol.
WORD_PATTERN = r"[\p{L}\p{N}]+"
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\t\n\x0B\f\r \p{L}\p{N}]"
# The same without the symbols that ``PUNCT_PATTERN`` takes.
NO_PUNCT_PATTERN = r"[\p{L}\p{N}]+|[^\t\n\x0B\f\r \p{L}\p{N}\p{P}]"
PUNCT_PATTERN = r"^\p{P}+$"
NON_ASCII_PATTERN = r"[^\x00-\x7F]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_strip(c) -> Column:
    """Lower case and trim (title normalisation)."""
    return F.lower(F.trim(_col(c)))


def tokenize(c) -> Column:
    """Text -> array of tokens: runs of letters/digits and single symbols.

    Whitespace never becomes a token. Null text gives an empty array.
    """
    return F.coalesce(F.regexp_extract_all(_col(c), F.lit(TOKEN_PATTERN), 0),
                      F.array().cast("array<string>"))


def is_punct(tok: Column) -> Column:
    return tok.rlike(PUNCT_PATTERN)


def is_ascii(tok: Column) -> Column:
    return ~tok.rlike(NON_ASCII_PATTERN)


def is_stop(tok: Column, stop_words=None) -> Column:
    words = K.STOP_WORDS_EN if stop_words is None else list(stop_words)
    return F.lower(tok).isin(words)


def keep_token(tok: Column, is_title: Column | None = None, stop: bool = True,
               stop_words=None) -> Column:
    """Token keep predicate.

    A token tagged as a title is always kept; otherwise punctuation, stop words
    (when ``stop``) and tokens with non-ASCII characters are dropped. Empty
    tokens never pass.
    """
    junk = is_punct(tok) | ~is_ascii(tok)
    if stop:
        junk = junk | is_stop(tok, stop_words)
    keep = ~junk & (F.length(F.trim(tok)) > 0)
    if is_title is not None:
        keep = is_title | keep
    return keep


# Exactly the tokens of ``TOKEN_PATTERN`` that ``keep_token`` keeps (before the
# stop-word test), found by one regex: whole letter/digit runs made only of ASCII
# letters and digits, and single ASCII symbols that are not punctuation.
KEPT_PATTERN = (r"(?<![\p{L}\p{N}])[a-z0-9]+(?![\p{L}\p{N}])"
                r"|[\x00-\x08\x0E-\x1F\x7F$+<=>^`|~]")


def filtered_tokens(text, stop: bool = True, stop_words=None) -> Column:
    """Text -> lower-cased tokens that pass :func:`keep_token` (no titles).

    Same result as filtering :func:`tokenize` with :func:`keep_token`, but the
    punctuation and ASCII tests happen inside one regex scan; only the stop-word
    lookup runs per token.
    """
    toks = F.coalesce(F.regexp_extract_all(F.lower(_col(text)), F.lit(KEPT_PATTERN), 0),
                      F.array().cast("array<string>"))
    if not stop:
        return toks
    words = K.STOP_WORDS_EN if stop_words is None else list(stop_words)
    return F.filter(toks, lambda t: ~t.isin(words))


def ngrams(arr, n_min: int = 1, n_max: int = 3, sep: str = " ") -> Column:
    """All n-grams with ``n_min <= n <= n_max`` over a token array.

    Each n-gram is its tokens joined by ``sep``; arrays shorter than ``n`` give
    no n-gram of that length. Built from ``n`` shifted slices zipped together,
    so the input array is referenced a fixed number of times (never once per
    position).
    """
    a = _col(arr)
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(a)
            continue
        width = F.greatest(F.size(a) - n + 1, F.lit(0))
        gram = F.slice(a, 1, width)
        for k in range(1, n):
            gram = F.zip_with(gram, F.slice(a, k + 1, width),
                              lambda x, y: F.concat(x, F.lit(sep), y))
        parts.append(gram)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def collapse_masked(c, replacement: str = K.MASK_REPLACEMENT) -> Column:
    """A run of four or more of the same mask symbol -> one word (case-sensitive)."""
    cls = "".join(re.escape(s) if s not in "|" else s for s in K.MASK_SYMBOLS)
    return F.regexp_replace(_col(c), F.lit(f"([{cls}])\\1{{3,}}"), F.lit(replacement))


def _alternation(items) -> str:
    return "(" + "|".join(re.escape(x) for x in items) + ")"


def replace_emoticons(c) -> Column:
    """Smile emoticons -> "smile", then sad ones -> "sad"."""
    out = F.regexp_replace(_col(c), F.lit(_alternation(K.SMILE_EMOTICONS)), F.lit(K.SMILE_WORD))
    return F.regexp_replace(out, F.lit(_alternation(K.SAD_EMOTICONS)), F.lit(K.SAD_WORD))


def normalize_emoticons(c) -> Column:
    """Masked words, then smiles, then sad faces (the fixed pre-rule steps)."""
    return replace_emoticons(collapse_masked(c))


class _FirstElement(HTMLParser):
    """Collects the text of the first element of a tag and class, inner elements included."""

    def __init__(self, tag: str, class_name: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.class_name, self.depth, self.found, self.text = tag, class_name, 0, False, []

    def handle_starttag(self, tag, attrs):
        if tag == self.tag and self.depth:
            self.depth += 1
        elif tag == self.tag and not self.found and self.class_name in (dict(attrs).get("class") or "").split():
            self.found, self.depth = True, 1

    def handle_startendtag(self, tag, attrs):  # "<div/>" opens a div in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == self.tag and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.text.append(data)


def first_element_text(html: str | None, tag: str, class_name: str) -> str | None:
    """Trimmed text of the first such element; None without one."""
    if not html or class_name not in html:
        return None
    parser = _FirstElement(tag, class_name)
    parser.feed(html)
    parser.close()
    return "".join(parser.text).strip() if parser.found else None


def element_text(html, class_name: str, tag: str = "div", default: str = K.MISSING_TITLE) -> Column:
    """Text of the first ``<tag>`` that has the class, as a CSS selector ``tag.class`` finds it.

    Elements inside it are part of it, comments and other attributes are not looked at, and every
    character reference is decoded; pages without such an element give ``default``. Nesting is beyond
    regular expressions, so a small parser runs in Arrow batches.
    """
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: first_element_text(page, tag, class_name)).astype(object)

    return F.coalesce(run(_col(html)), F.lit(default))

"""DuckDB SQL fragments used by the oracle queries.

They restate, in plain SQL, the same definitions the Spark code uses
(tokens, kept tokens, n-grams), so each oracle query is independent of Spark.
"""

from __future__ import annotations

from revspark.functions import constants as K


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]"


STOP_LIST = sql_list(K.STOP_WORDS_EN)

TOKEN_RE = r"[\p{L}\p{N}]+|[^\t\n\x0B\f\r \p{L}\p{N}]"


def tokens(text: str) -> str:
    """All tokens of ``text`` (words and single symbols)."""
    return f"regexp_extract_all({text}, '{TOKEN_RE}')"


def kept_tokens(text: str, stop: bool = True) -> str:
    """Lower-cased tokens that are not punctuation, not non-ASCII and not stop words."""
    cond = (r"NOT regexp_matches(t, '^\p{P}+$') AND NOT regexp_matches(t, '[^\x00-\x7F]')"
            r" AND length(trim(t)) > 0")
    if stop:
        cond += f" AND NOT list_contains({STOP_LIST}, t)"
    return f"list_filter({tokens(f'lower({text})')}, lambda t: {cond})"


def ngrams(a: str, n_min: int = 1, n_max: int = 3) -> str:
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(a)
            continue
        joined = " || ' ' || ".join(f"{a}[i + {k}]" if k else f"{a}[i]" for k in range(n))
        parts.append(f"list_transform(range(1, len({a}) - {n - 2}), lambda i: {joined})")
    return parts[0] if len(parts) == 1 else "list_concat(" + ", ".join(parts) + ")"

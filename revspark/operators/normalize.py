"""Ordered text rewrite rules.

Rules run strictly in order, each on the text the previous ones produced,
case-insensitively (Unicode-aware). A rule may be scoped to rows whose title
contains a pattern.

A rule is tried only where the text holds one of the words that its pattern requires, which a
plain search finds at the rule's turn. Rules run in order, each pattern a literal compiled
once per task, as one fold over the rules (never nested projections). All JVM-side: no
Python worker touches the text.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "review_rules.json")

@dataclass(frozen=True)
class Rule:
    order: int
    pattern: str
    replacement: str
    scope_title: str | None = None
    literal: str | tuple = ""
    match: str = "substring"  # or "word": only where not inside a word

    @property
    def gate(self) -> tuple[str, ...]:
        return (self.literal,) if isinstance(self.literal, str) and self.literal \
            else tuple(self.literal or ())


_META = set(".^$*+?()[]{}|\\")


def _split_top(pattern: str) -> list[str]:
    """Top-level alternation branches (outside groups and classes)."""
    out, cur, depth, i, in_cls = [], "", 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            cur += pattern[i:i + 2]
            i += 2
            continue
        if in_cls:
            in_cls = c != "]"
        elif c == "[":
            in_cls = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(cur)
            cur = ""
            i += 1
            continue
        cur += c
        i += 1
    out.append(cur)
    return out


def _skip_group(b: str, i: int) -> int:
    """Index after the group or class starting at ``b[i]``."""
    close = "]" if b[i] == "[" else ")"
    depth, j = 0, i
    while j < len(b):
        c = b[j]
        if c == "\\":
            j += 2
            continue
        if close == "]":
            if c == "]" and j > i + 1:
                return j + 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return j + 1
        j += 1
    return len(b)


def _branch_literal(b: str) -> str:
    """Longest run of plain characters every match of branch ``b`` must contain."""
    runs, cur, i = [], "", 0
    while i < len(b):
        c = b[i]
        if c in "([":
            runs.append(cur)
            cur = ""
            i = _skip_group(b, i)
            continue
        if c == "\\":
            nxt = b[i + 1] if i + 1 < len(b) else ""
            i += 2
            if nxt.isalnum() or not nxt:
                runs.append(cur)
                cur = ""
            else:
                cur += nxt
            continue
        if c in "*?":
            cur = cur[:-1]
            runs.append(cur)
            cur = ""
            i += 1
            continue
        if c == "{":
            j = b.find("}", i)
            lo = b[i + 1:j].split(",")[0] if j > 0 else "0"
            if not lo.strip().isdigit() or int(lo) == 0:
                cur = cur[:-1]
            runs.append(cur)
            cur = ""
            i = j + 1 if j > 0 else len(b)
            continue
        if c in "+":
            runs.append(cur)
            cur = ""
            i += 1
            continue
        if c in ".^$":
            runs.append(cur)
            cur = ""
            i += 1
            continue
        cur += c
        i += 1
    runs.append(cur)
    best = max(runs, key=len)
    # Only characters whose case-insensitive matches ``lower`` maps onto
    # themselves (ASCII, or characters without case) make a safe gate.
    if not all(ord(ch) < 128 or (ch.lower() == ch and ch.upper() == ch) for ch in best):
        return ""
    return best.lower()


def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which every match contains at least one; () when unknown."""
    lits = []
    for b in _split_top(pattern):
        lit = _branch_literal(b)
        if not lit:
            return ()
        lits.append(lit)
    return tuple(dict.fromkeys(lits))


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def load_rules(path: str | None = None, on_bad_rule: str = "error") -> list[Rule]:
    """Rules from a JSON file ``{"generic": [{term, replace}], "game": [{title, terms, replace}]}``.

    ``on_bad_rule``: "error" raises on an invalid pattern, "skip" drops it,
    "literal" matches its text literally.
    """
    with open(path or RULES_PATH, encoding="utf-8") as fh:
        raw = json.load(fh)
    rules, order = [], 0
    entries = [(None, g["term"], g["replace"]) for g in raw.get("generic", [])]
    for scoped in raw.get("game", []):
        terms = scoped.get("terms", scoped.get("term", []))
        entries += [(scoped["title"], t, r) for t, r in zip(terms, scoped["replace"])]
    for scope, pat, rep in entries:
        if not _valid(pat):
            if on_bad_rule == "error":
                raise ValueError(f"invalid rule pattern #{order}: {pat!r}")
            if on_bad_rule == "skip":
                continue
            pat = re.escape(pat)
        rules.append(Rule(order, pat, rep, scope, required_literals(pat)))
        order += 1
    return rules


def plain_rules(path: str | None = None) -> list[Rule]:
    """The generic rules without look-around and without escaped classes, which every engine reads alike."""
    return [r for r in load_rules(path, on_bad_rule="skip")
            if r.scope_title is None and "(?" not in r.pattern and not re.search(r"\\[a-zA-Z]", r.pattern)]


def java_pattern(rule: Rule) -> str:
    p = rule.pattern
    if rule.match == "word":
        p = rf"(?<![\w])(?:{p})(?![\w])"
    return "(?iU)" + p


def _java_replacement(rep: str) -> str:
    return rep.replace("\\", "\\\\").replace("$", "\\$")


def rule_step(text: Column, rule: Rule, title: Column | None = None) -> Column:
    """One rule applied to ``text`` (gated, scoped)."""
    replaced = F.regexp_replace(text, F.lit(java_pattern(rule)),
                                F.lit(_java_replacement(rule.replacement)))
    cond = None
    if rule.gate:
        # Same case folding as the rule itself, so the gate never skips a match;
        # one pass over the text, no lower-cased copy.
        lits = "|".join(r"\Q" + lit + r"\E" for lit in rule.gate)
        cond = text.rlike(f"(?iu)(?:{lits})")
    if rule.scope_title is not None:
        if title is None:
            raise ValueError("scoped rules need a title column")
        scope = F.coalesce(title.rlike("(?iU)" + rule.scope_title), F.lit(False))
        cond = scope if cond is None else (scope & cond)
    return replaced if cond is None else F.when(cond, replaced).otherwise(text)


def _folded(text: Column) -> Column:
    """``text`` with its case folded so that every literal of a gate that a rule's pattern finds in it is in it."""
    # patterns take these for ASCII letters, lower case does not
    for other, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        text = F.replace(text, F.lit(other), F.lit(letter))
    return F.lower(text)


def _replaced(text: Column, rule: Rule, title: Column | None) -> Column:
    out = F.regexp_replace(text, F.lit(java_pattern(rule)), F.lit(_java_replacement(rule.replacement)))
    if rule.scope_title is None:
        return out
    if title is None:
        raise ValueError("scoped rules need a title column")
    return F.when(F.coalesce(title.rlike("(?iU)" + rule.scope_title), F.lit(False)), out).otherwise(text)


def apply_rules(df: DataFrame, rules: list[Rule], text_col: str, out_col: str | None = None,
                title_col: str | None = None) -> DataFrame:
    """Apply ``rules`` in order to ``text_col``; the result goes to ``out_col``.

    A rule runs only on a text that holds a literal of its gate, which a plain search in the folded
    text finds; a rewrite folds the new text.
    """
    out = out_col or text_col
    rules = sorted(rules, key=lambda r: r.order)
    if not rules:
        return df.withColumn(out, F.col(text_col))
    title = F.col(title_col) if title_col else None
    gates = F.array(*[F.array(*[F.lit(g) for g in r.gate]).cast("array<string>") for r in rules])

    def state_of(text: Column) -> Column:
        return F.struct(text.alias("text"), _folded(text).alias("folded"))

    def one(state: Column, number: Column) -> Column:
        text, gate = state["text"], F.get(gates, number)
        case = None
        for i, rule in enumerate(rules):
            new = _replaced(text, rule, title)
            case = F.when(number == i, new) if case is None else case.when(number == i, new)
        # the array names the new text, so that it is computed once
        step = F.transform(F.array(case), lambda new: F.when(new == text, state).otherwise(state_of(new)))
        can_fire = (F.size(gate) == 0) | F.exists(gate, lambda lit: F.contains(state["folded"], lit))
        return F.when(can_fire, F.get(step, F.lit(0))).otherwise(state)

    numbers = F.array(*[F.lit(i) for i in range(len(rules))])
    return df.withColumn(out, F.aggregate(numbers, state_of(F.col(text_col).cast("string")), one, lambda state: state["text"]))


def normalize_reviews(df: DataFrame, rules: list[Rule], text_col: str = "user_review",
                      title_col: str | None = "title") -> DataFrame:
    """Masked words and emoticons first, then the ordered rules."""
    from revspark.functions.text import normalize_emoticons
    df = df.withColumn(text_col, normalize_emoticons(F.col(text_col)))
    return apply_rules(df, rules, text_col, title_col=title_col)

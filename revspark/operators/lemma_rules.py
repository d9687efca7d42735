"""Lemmas of unseen forms by suffix rules learned from (form, lemma) pairs.

A pair gives an edit: what is left of the form behind the part both share goes, what is
left of the lemma comes. The edit is counted under each ending of the form that holds
the part that goes, up to ``MAX_SUFFIX`` letters, so ``stories -> story`` counts for
"ies", "ries", "ories". Of an ending's edits the most frequent is its rule, ties to the
one that removes fewer letters, then to the smaller addition. A form takes the rule of
its longest known ending; without one it stays.

Learning is two aggregations, applying one join of the distinct forms' endings; an
ending shared by most forms is one row of the rules, and forms are looked up once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SUFFIX = 5


def _shared(a: Column, b: Column) -> Column:
    """Number of leading characters two strings share."""
    upto = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), upto), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.array_max(same)


def _endings(form: Column, least: Column) -> Column:
    """Endings of ``least`` to ``MAX_SUFFIX`` letters; a form is never its own ending."""
    longest = F.least(F.length(form) - 1, F.lit(MAX_SUFFIX))
    sizes = F.filter(F.sequence(F.lit(0), F.lit(MAX_SUFFIX)), lambda n: (n >= least) & (n <= longest))
    return F.transform(sizes, lambda n: F.substring(form, F.length(form) - n + 1, n))


def learn_suffix_rules(pairs: DataFrame, min_count: int = 2) -> DataFrame:
    """``(suffix, cut, added, count)`` from distinct ``(form, lemma)`` pairs, one rule an ending.

    ``cut`` is the number of letters that go. Rules of fewer than ``min_count`` pairs are left out.
    """
    rows = pairs.select("form", "lemma").where(F.col("form").isNotNull() & F.col("lemma").isNotNull()).distinct()
    rows = rows.withColumn("keep", _shared(F.col("form"), F.col("lemma")))
    edits = rows.select("form", (F.length("form") - F.col("keep")).alias("cut"),
                        F.substring(F.col("lemma"), F.col("keep") + 1, F.length("lemma")).alias("added"))
    counted = (edits.select("cut", "added", F.explode(_endings(F.col("form"), F.col("cut"))).alias("suffix"))
               .groupBy("suffix", "cut", "added").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count))
    best = F.min(F.struct((-F.col("count")).alias("n"), "cut", "added")).alias("b")
    return (counted.groupBy("suffix").agg(best)
            .select("suffix", F.col("b.cut").alias("cut"), F.col("b.added").alias("added"), (-F.col("b.n")).alias("count")))


def apply_suffix_rules(forms: DataFrame, rules: DataFrame, form_col: str = "form") -> DataFrame:
    """``(form, lemma)`` of the distinct forms of ``forms``."""
    own = forms.select(F.col(form_col).alias("form")).where(F.col("form").isNotNull()).distinct()
    ends = own.select("form", F.explode(_endings(F.col("form"), F.lit(0))).alias("suffix"))
    longest = F.max(F.struct(F.length("suffix").alias("n"), "cut", "added")).alias("r")
    found = ends.join(rules, "suffix").groupBy("form").agg(longest)
    lemma = F.concat(F.substring(F.col("form"), F.lit(1), F.length("form") - F.col("r.cut")), F.col("r.added"))
    return own.join(found, "form", "left").select("form", F.coalesce(lemma, F.col("form")).alias("lemma"))


def lemmas_for(tokens: DataFrame, known: DataFrame, rules: DataFrame, token_col: str = "token") -> DataFrame:
    """A ``(form, lemma)`` table for every form of ``tokens``: the known lemma, else by the rules."""
    forms = tokens.select(F.lower(F.col(token_col)).alias("form")).distinct()
    unseen = forms.join(known.select("form"), "form", "left_anti")
    listed = known.groupBy("form").agg(F.min("lemma").alias("lemma")).join(forms, "form", "left_semi")
    return listed.unionByName(apply_suffix_rules(unseen, rules))


def pairs_of_vocabulary(vocab: DataFrame, endings: tuple[str, ...], term_col: str = "term") -> DataFrame:
    """``(form, lemma)`` for words of a vocabulary that are another of its words (three letters or
    more) and one of ``endings``; the longest ending wins."""
    words = vocab.select(F.col(term_col).alias("form")).distinct()
    cut = F.explode(F.filter(F.array(*[F.lit(e) for e in endings]),
                             lambda e: F.endswith(F.col("form"), e) & (F.length("form") - F.length(e) >= 3)))
    tried = words.select("form", cut.alias("ending")).withColumn(
        "lemma", F.expr("substring(form, 1, length(form) - length(ending))"))
    kept = tried.join(words.select(F.col("form").alias("lemma")), "lemma", "left_semi")
    first = Window.partitionBy("form").orderBy(F.length("ending").desc())
    return kept.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).select("form", "lemma")

"""Token tables: title dictionary, title phrase tagging, token filter, lemmas.

Title tagging is an equi-join, never a document x title product: documents find
the title beginnings they hold, cut candidates only there, look each up by its
required tokens, and overlapping matches are resolved per document (longest
first, then earliest) with array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revspark.functions import constants as K
from revspark.functions.text import NO_PUNCT_PATTERN, is_punct, keep_token, lower_strip, ngrams, tokenize
from revspark.operators.features import dealt_by
from revspark.session import scratch_path


def title_dictionary(titles: DataFrame, aliases=None, title_col: str = "title") -> DataFrame:
    """Distinct lower-cased, trimmed titles plus the alias list (missing titles dropped)."""
    spark = titles.sparkSession
    alias_rows = [(a,) for a in (K.TITLE_ALIASES if aliases is None else aliases)]
    base = titles.select(lower_strip(title_col).alias("title")) \
        .filter(F.col("title").isNotNull() & (F.col("title") != lower_strip(F.lit(K.MISSING_TITLE)))
                & (F.col("title") != ""))
    extra = spark.createDataFrame(alias_rows, "title string")
    return base.unionByName(extra).distinct()


def _word_layout(df: DataFrame, tok_col: str) -> DataFrame:
    """Adds ``widx`` (1-based positions of the tokens that are not punctuation) and ``gaps`` (the
    punctuation before each of them and, last, after all), in two projections so each
    array is built once."""
    n = F.size(tok_col)
    widx = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: (i <= n) & ~is_punct(F.element_at(F.col(tok_col), i)))
    df = df.withColumn("widx", widx)
    prev_end = lambda j: F.when(j == 0, F.lit(1)).otherwise(F.element_at("widx", j) + 1)
    gaps = F.transform("widx", lambda p, j: F.array_join(
        F.slice(F.col(tok_col), prev_end(j), p - prev_end(j)), ""))
    last = F.when(F.size("widx") > 0, F.element_at("widx", -1)).otherwise(F.lit(0))
    after = F.array_join(F.slice(F.col(tok_col), last + 1, F.greatest(n - last, F.lit(0))), "")
    return df.withColumn("gaps", F.concat(gaps, F.array(after)))


def title_patterns(dictionary: DataFrame) -> DataFrame:
    """``(key, n, head, tgaps, title)``: the required tokens of each title, their count, the first one
    or two of them, and the punctuation before, between and after them, every mark of which is
    optional in the text. Titles of punctuation alone name nothing and are dropped."""
    toks = dictionary.select("title", tokenize(F.col("title")).alias("_t"))
    pat = _word_layout(toks, "_t")
    words = F.transform("widx", lambda i: F.element_at(F.col("_t"), i))
    return (pat.select(F.array_join(words, " ").alias("key"), F.size("widx").alias("n"),
                       F.array_join(F.slice(words, 1, 2), " ").alias("head"),
                       F.col("gaps").alias("tgaps"), "title").filter(F.col("n") > 0))


def doc_words(docs: DataFrame, keep=()) -> DataFrame:
    """``(doc_id, *keep, toks, widx, gaps)`` of ``(doc_id, text)``: lower-cased tokens, positions of those that are not
    punctuation, punctuation around them."""
    t = docs.select("doc_id", *keep, tokenize(F.lower("text")).alias("toks"))
    # generated, so that no lambda that names one of them makes it again for every element
    return _word_layout(t, "toks").select("doc_id", *keep, F.inline(F.array(F.struct("toks", "widx", "gaps"))))


def _marks_left(gap: Column, marks: Column) -> Column:
    """What is left of ``gap`` when its characters are matched, in order, against ``marks``, each mark optional."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marks), F.lit(1))),
                       lambda i: F.substring(marks, i, F.lit(1)))
    return F.aggregate(each, gap, lambda rest, c: F.when(
        (F.length(c) > 0) & F.startswith(rest, c), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest))


def _heads_present(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(doc_id, heads)``: title beginnings (one or two tokens) that occur in each document.

    One row per document and distinct beginning meets the distinct beginnings of the titles in a join.
    """
    flat = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(NO_PUNCT_PATTERN), F.lit(0)).alias("w"))
    flat = flat.select("doc_id", F.array_distinct(ngrams("w", 1, 2)).alias("h"))
    pairs = flat.select("doc_id", F.explode_outer("h").alias("head")).filter(F.col("head").isNotNull())
    found = pairs.join(patterns.select("head").distinct(), "head")
    return found.groupBy("doc_id").agg(F.collect_set("head").alias("heads"))


def title_candidates(docs: DataFrame, patterns: DataFrame, lengths) -> DataFrame:
    """Every match of a title in ``(doc_id, text)``: its required tokens in a row, with any of its punctuation left out.

    Documents first learn which title beginnings they hold; only those that hold one are laid out, and only there
    candidates of the title ``lengths`` are cut, inside the document's row, and looked up by an equi-join on the
    required tokens. Between them, the document's punctuation must be some of the title's, in order; before and after
    them the span takes in as much as the title allows.
    """
    word_at = lambda s: F.element_at(F.col("toks"), F.element_at(F.col("widx"), s))
    docs = dealt_by(docs)  # the texts move, once for both uses; not their tokens
    words = doc_words(docs.join(_heads_present(docs, patterns), "doc_id"), ["heads"])
    every = F.sequence(F.lit(1), F.size("widx"))
    one = F.filter(every, lambda s: F.array_contains("heads", word_at(s)))
    two = F.filter(every, lambda s: (s < F.size("widx")) & F.array_contains(
        "heads", F.concat(word_at(s), F.lit(" "), word_at(s + 1))))
    words = words.withColumn("_one", one).withColumn("_two", two)
    parts = []
    for n in sorted(set(lengths)):
        starts = F.filter("_one" if n == 1 else "_two", lambda s: s <= F.size("widx") - n + 1)
        parts.append(F.transform(starts, lambda s: F.struct(
            F.lit(n).alias("n"),
            F.array_join(F.transform(F.slice("widx", s, n),
                                     lambda i: F.element_at(F.col("toks"), i)), " ").alias("key"),
            F.slice("gaps", s, n + 1).alias("dgaps"),
            F.element_at("widx", s).alias("first"),
            F.element_at("widx", s + n - 1).alias("last"))))
    allc = parts[0] if len(parts) == 1 else F.concat(*parts)
    cand = words.select("doc_id", F.explode_outer(allc).alias("c")) \
        .filter(F.col("c").isNotNull()).select("doc_id", "c.*")
    m = cand.join(patterns.drop("head"), ["key", "n"])
    inner = F.forall(F.sequence(F.lit(2), F.greatest(F.col("n"), F.lit(2))),
                     lambda k: (k > F.col("n")) | (_marks_left(F.element_at("dgaps", k), F.element_at("tgaps", k)) == ""))
    before, after = F.element_at("dgaps", 1), F.element_at("dgaps", -1)
    taken_before = F.length(before) - F.length(_marks_left(F.reverse(before), F.reverse(F.element_at("tgaps", 1))))
    taken_after = F.length(after) - F.length(_marks_left(after, F.element_at("tgaps", -1)))
    m = (m.filter(inner).withColumn("tok_start", (F.col("first") - taken_before).cast("int"))
         .withColumn("tok_end", (F.col("last") + taken_after).cast("int")))
    return m.select("doc_id", F.col("tok_start").alias("start"),
                    (F.col("tok_end") - F.col("tok_start") + 1).alias("n"), "tok_start", "tok_end", "title").distinct()


def resolve_spans(cand: DataFrame) -> DataFrame:
    """Greedy non-overlapping spans per document: longest first, then earliest.

    One group per document (bounded by that document's matches); the choice is
    an ``aggregate`` over the sorted candidates.
    """
    span = F.struct("n", "start", "tok_start", "tok_end", "title")
    grouped = cand.groupBy("doc_id").agg(F.collect_list(span).alias("c"))
    ordered = F.array_sort("c", lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1)
                           .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                           .when(a["title"] < b["title"], -1).when(a["title"] > b["title"], 1)
                           .otherwise(0))
    empty = F.array().cast(grouped.schema["c"].dataType)
    kept = F.aggregate(ordered, empty, lambda acc, x: F.when(
        F.exists(acc, lambda y: (x["start"] < y["start"] + y["n"]) & (y["start"] < x["start"] + x["n"])),
        acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.*")


def tag_titles(docs: DataFrame, dictionary: DataFrame, text_col: str = "text",
               id_col: str = "doc_id") -> DataFrame:
    """Title spans ``(doc_id, start, n, tok_start, tok_end, title)``: 1-based token positions,
    ``n`` tokens from ``start``, the optional punctuation found included."""
    path = scratch_path(docs.sparkSession, "title-patterns")  # read several times below: titles are found once
    title_patterns(dictionary).write.parquet(path)
    patterns = docs.sparkSession.read.parquet(path)
    # the distinct title lengths, a handful of numbers; the dictionary itself stays distributed
    lengths = [r[0] for r in patterns.select("n").distinct().collect()]
    if not lengths:
        schema = "doc_id bigint, start int, n int, tok_start int, tok_end int, title string"
        return docs.sparkSession.createDataFrame([], schema)
    return resolve_spans(title_candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), patterns, lengths))


def kept_with_titles(docs: DataFrame, spans: DataFrame, stop: bool = True,
                     text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Kept tokens in order, where tokens inside a title span are always kept.

    ``(doc_id, tokens)``; spans come from :func:`tag_titles`.
    """
    ranges = spans.groupBy("doc_id").agg(
        F.collect_list(F.struct("tok_start", "tok_end")).alias("_r"))
    t = dealt_by(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))).join(ranges, "doc_id", "left")
    # generated, so that no lambda that names the tokens makes them again for every element
    t = t.select("doc_id", "_r", F.explode(F.array(tokenize(F.lower("_text")))).alias("toks"))
    in_title = lambda i: F.coalesce(F.exists("_r", lambda r: (i >= r["tok_start"]) & (i <= r["tok_end"])),
                                     F.lit(False))
    idx = F.sequence(F.lit(1), F.greatest(F.size("toks"), F.lit(1)))
    keep_idx = F.filter(idx, lambda i: (i <= F.size("toks"))
                        & keep_token(F.element_at("toks", i), in_title(i), stop))
    return t.select("doc_id", F.transform(keep_idx, lambda i: F.trim(F.element_at("toks", i)))
                    .alias("tokens"))


def lemma_table_from_vocab(vocab: DataFrame, term_col: str = "term") -> DataFrame:
    """A ``(form, lemma)`` table derived from a vocabulary: a word ending in "s"
    whose stem is itself in the vocabulary folds to that stem."""
    terms = vocab.select(F.col(term_col).alias("form")).distinct()
    stem = F.when(F.col("form").rlike("^[a-z]{3,}s$"), F.expr("substring(form, 1, length(form) - 1)"))
    # a term meets its plural (a stem has one form), so that the vocabulary is made once
    asked = terms.select(F.explode(F.array(
        F.struct(F.col("form").alias("lemma"), F.lit(None).cast("string").alias("form")),
        F.struct(stem.alias("lemma"), F.col("form").alias("form")))).alias("x")).select("x.*").where(F.col("lemma").isNotNull())
    met = asked.groupBy("lemma").agg(F.max(F.col("form").isNull()).alias("_known"), F.max("form").alias("form"))
    return met.where(F.col("_known") & F.col("form").isNotNull()).select("form", "lemma")


def lemmatize(tokens: DataFrame, lemmas: DataFrame | None, token_col: str = "token") -> DataFrame:
    """Replace each token by its lemma (lower-cased, trimmed); identity when none.

    ``lemmas`` is a user table ``(form, lemma)``. Tokens that carry a position (``pos``) are looked up
    once per document and form, so a hot token meets the join as one row a document.
    """
    if lemmas is None:
        return tokens.withColumn(token_col, F.lower(F.trim(F.col(token_col))))
    lm = lemmas.groupBy(F.col("form").alias("_form")).agg(F.min("lemma").alias("_lemma"))
    own = [c for c in tokens.columns if c != "pos"]
    positions = "pos" in tokens.columns
    rows = tokens.groupBy(*own).agg(F.collect_list("pos").alias("_at")) if positions else tokens
    out = rows.join(lm, F.lower(F.col(token_col)) == F.col("_form"), "left")
    out = out.withColumn(token_col, F.lower(F.trim(F.coalesce("_lemma", F.col(token_col))))) \
        .drop("_form", "_lemma")
    if not positions:
        return out
    if "doc_id" in own:  # a document's forms go back to it before they become one row a position
        out = dealt_by(out)
    return out.withColumn("pos", F.explode("_at")).select(*tokens.columns)

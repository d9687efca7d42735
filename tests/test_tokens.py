"""Title phrase tagging against a brute-force greedy matcher."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from revspark.operators import tokens as TK

TOKEN_RE = re.compile(r"[^\W_]+|[^\s\w]|_", re.UNICODE)


def brute_spans(text, titles):
    """By the rule: each token of a title must come in order, punctuation tokens may be left out, one by one."""
    toks = TOKEN_RE.findall(text.lower())

    def punct(t):
        return all(unicodedata.category(c).startswith("P") for c in t)

    def ends(pattern, at):
        if not pattern:
            return {at}
        out = ends(pattern[1:], at) if punct(pattern[0]) else set()
        if at < len(toks) and toks[at] == pattern[0]:
            out |= ends(pattern[1:], at + 1)
        return out

    cands = set()
    for title in titles:
        pattern = TOKEN_RE.findall(title.lower())
        if all(punct(t) for t in pattern):
            continue
        for s in range(len(toks)):
            for e in ends(pattern, s):
                cands.add((e - s, s + 1, title.lower()))
    kept = []
    for n, s, title in sorted(cands, key=lambda c: (-c[0], c[1], c[2])):
        if all(s + n <= ks or ks + kn <= s for kn, ks, _ in kept):
            kept.append((n, s, title))
    return sorted((s, n, t) for n, s, t in kept)


def test_tag_titles_matches_brute_force(spark):
    rnd = random.Random(7)
    vocab = ["fallout", "new", "vegas", "bad", "company", "sky", "rim", "the", "x", "a", "b", "plus", "two"]
    titles = ["fallout: new vegas", "new vegas", "bad company!", "fallout", "sky rim", "x x x", "a - : b", "plus+ two",
              "(the) rim?!", "...", "+"]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(rnd.randint(0, 25)):
            parts.append(rnd.choice(vocab))
            if rnd.random() < 0.3:
                parts.append(rnd.choice([":", ",", "!", "+", "-", "- :", "(", ")", "?!"]))
        docs.append((i, " ".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    dic = spark.createDataFrame([(t,) for t in titles], "title string")
    got = {}
    for r in TK.tag_titles(df, TK.title_dictionary(dic, aliases=[])).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n, r.title))
    for i, text in docs:
        assert sorted(got.get(i, [])) == brute_spans(text, titles), (i, text)


def test_title_rule_probes(spark):
    texts = ["x a : b y", "a-:b", "bad company!", "plus two plus+ two", "Bad, Company"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dic = spark.createDataFrame([(t,) for t in ["a - : b", "bad company!", "plus+ two"]], "title string")
    got = sorted((r.doc_id, r.start, r.n) for r in TK.tag_titles(df, TK.title_dictionary(dic, aliases=[])).collect())
    assert got == [(0, 2, 3), (1, 1, 4), (2, 1, 3), (3, 3, 3)]


def test_span_resolution_f9(spark):
    cand = spark.createDataFrame(
        [(1, s, n, s, s + n - 1, f"t{n}{s}") for n, s in [(3, 1), (2, 2), (2, 4), (1, 7), (1, 4)]],
        "doc_id long, start int, n int, tok_start int, tok_end int, title string")
    got = sorted((r.n, r.start) for r in TK.resolve_spans(cand).collect())
    assert got == sorted([(3, 1), (2, 4), (1, 7)])


def test_lemmatize_identity_and_table(spark):
    toks = spark.createDataFrame([(1, 0, "Games"), (1, 1, "run")], "doc_id long, pos long, token string")
    lem = spark.createDataFrame([("games", "game")], "form string, lemma string")
    assert [r.token for r in TK.lemmatize(toks, lem).orderBy("pos").collect()] == ["game", "run"]
    again = spark.createDataFrame([(1, p, "games") for p in range(4)] + [(2, 0, "games")], "doc_id long, pos long, token string")
    assert sorted(tuple(r) for r in TK.lemmatize(again, lem).collect()) == [(1, p, "game") for p in range(4)] + [(2, 0, "game")]
    assert [r.token for r in TK.lemmatize(toks, None).orderBy("pos").collect()] == ["games", "run"]


def test_lemmas_move_the_pairs_once_by_token_and_once_back(spark):
    """Documents dealt out by id: neither the grouping of their tokens nor that of their lemmas moves them again."""
    from revspark.operators import features as FE
    docs = spark.createDataFrame([(1, "cars car bus"), (2, "cars games"), (2, "game gas ga"), (3, None)], "doc_id long, text string")
    toks = FE.kept_token_table(FE.by_document(docs, "text")).filter("token IS NOT NULL")
    lemmas = TK.lemma_table_from_vocab(toks.select(F.col("token").alias("term")))
    assert sorted(tuple(r) for r in lemmas.collect()) == [("cars", "car"), ("games", "game")]
    # "gas" is too short a word, "bus" has no stem here
    out = TK.lemmatize(toks, lemmas).groupBy("doc_id").agg(F.array_sort(F.collect_list("token")).alias("t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id: r.t for r in out.collect()} == {1: ["bus", "car", "car"], 2: ["car", "ga", "game", "game", "gas"]}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_doc = [line for line in plan.splitlines() if "hashpartitioning(doc_id" in line]
    assert by_doc and all("REPARTITION_BY_NUM" in line for line in by_doc)


def test_titles_are_found_once_and_words_need_no_layout(spark):
    from revspark.functions.text import NO_PUNCT_PATTERN, is_punct, tokenize
    from revspark.plans.catalog import QUERIES
    tagged = QUERIES["tag_titles"](spark, "/root/testdata/sf0.001")
    assert "ArrowEvalPython" not in tagged._jdf.queryExecution().optimizedPlan().toString()
    text = "a—b c-d (e) “f” 1,2 $3 ★ x_y 　日本。\U0001f600!? é́"
    row = spark.createDataFrame([(text,)], "t string").select(
        F.filter(tokenize("t"), lambda x: ~is_punct(x)).alias("a"), F.regexp_extract_all("t", F.lit(NO_PUNCT_PATTERN), F.lit(0)).alias("b")).first()
    assert row.a == row.b

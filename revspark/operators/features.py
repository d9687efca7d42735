"""Counts, vocabularies and TF-IDF as long tables.

The document-term matrix is kept as a long table ``(doc_id, term, ...)`` so the
vocabulary never has to fit on the driver or in one task:

* term frequency: explode n-grams and ``groupBy(doc_id, term)`` -- map-side
  partial aggregation collapses each document before the shuffle; where every
  n-gram would move, the texts move instead (``by_document``), a document to one
  task, and the groups need no exchange of their own;
* document frequency: ``groupBy(term)`` over the tf table (partial aggregation
  again, so a term present in every document is one row per map task);
* tf x idf: equi-join on ``term``. AQE turns it into a broadcast join when the
  vocabulary stage is measured to be small, and splits skewed partitions
  (very common terms) when it is not;
* L2 norm: a window over ``doc_id`` (one document per window partition, bounded
  by the document's length) instead of aggregate + join-back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.functions.text import filtered_tokens, ngrams, tokenize
from revspark.session import stored


def dealt_by(rows: DataFrame, col: str = "doc_id") -> DataFrame:
    """``rows`` dealt out by ``col`` to all of the session's tasks; groups within its values then need no exchange."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), col)


def by_document(docs: DataFrame, *cols: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (its id and ``cols``) dealt out by id: groups of a document's tokens then stay where they are."""
    return dealt_by(docs.select(id_col, *cols), id_col)


def doc_terms(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              n_min: int = 1, n_max: int = 3, tokenizer=None, stop: bool = True, keep=()) -> DataFrame:
    """``(doc_id, *keep, terms)``: the n-grams of each document's kept tokens.

    ``tokenizer`` maps the text column to an array of tokens; by default the
    lower-cased tokens that pass ``keep_token``.
    """
    toks = tokenizer(F.col(text_col)) if tokenizer is not None else filtered_tokens(text_col, stop)
    # Tokens first, in their own projection: the n-gram lambdas then read a
    # column instead of re-running the tokenizer for every position.
    made = docs.select(F.col(id_col).alias("doc_id"), *keep, toks.alias("_toks"))
    return made.select(*made.columns[:-1], ngrams(F.col("_toks"), n_min, n_max).alias("terms"))


def term_counts(terms: DataFrame, every: bool = False) -> DataFrame:
    """``(doc_id, ..., term, tf)`` from ``(doc_id, ..., terms)``; ``every``: a document without terms has a row of a null term."""
    own = [c for c in terms.columns if c != "terms"]
    # explode_outer: plain explode makes Catalyst infer a size(terms) > 0 filter
    # and push it under the projection, re-running the tokenizer for it.
    rows = terms.select(*own, F.explode_outer("terms").alias("term"))
    return ((rows if every else rows.filter(F.col("term").isNotNull()))
            .groupBy(*own, "term").agg(F.count(F.lit(1)).alias("tf")))


def corpus_counts(tf: DataFrame) -> DataFrame:
    """``(term, df, cf)``: documents containing the term, and total occurrences."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def build_vocab(tf: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """``(term, df, cf)`` for terms with ``df >= min_df``.

    With ``max_features`` only the most frequent terms (by ``cf``, ties by term)
    are kept -- a top-k, which Spark runs as a per-partition top-k plus a
    final merge of ``k`` rows per partition.
    """
    vocab = corpus_counts(tf).filter(F.col("df") >= min_df)
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("cf"), F.asc("term")).limit(int(max_features))
    return vocab


def alphabetical_ids(vocab: DataFrame, term_col: str = "term", start: int = 1,
                     num_partitions: int | None = None) -> DataFrame:
    """Give each term its 1-based rank in byte order of ``term``.

    A global rank without a single-partition window: range-partition by term,
    sort each partition, number rows inside it, and add the row counts of all
    earlier partitions (a table of one row per partition, broadcast).

    The sorted partitions are stored with their rows' places before numbering: sizes
    and numbers must come from the very same partition contents, and a re-run of
    the range shuffle could sample other bounds.
    """
    spark = vocab.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(vocab.repartitionByRange(n, F.col(term_col)).sortWithinPartitions(term_col)
                    .withColumn("_mid", F.monotonically_increasing_id()), "ranked-terms")
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33)) \
                   .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    offsets = offsets.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn("id", (F.col("_off") + F.col("_local") + F.lit(start)).cast("bigint"))
            .drop("_mid", "_pid", "_local", "_off"))


def smooth_idf(df_col: Column, n_docs: Column) -> Column:
    """``ln((1 + n) / (1 + df)) + 1``."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df_col)) + F.lit(1.0)


@dataclass
class TfIdfModel:
    """Fitted TF-IDF state: ``vocab`` is ``(term, df, idf)``; nothing is collected."""

    vocab: DataFrame
    n_docs: int | None
    n_min: int = 1
    n_max: int = 3
    tokenizer: object = None
    stop: bool = True
    text_col: str = "text"
    id_col: str = "doc_id"

    def transform(self, docs: DataFrame, normalize: bool = True) -> DataFrame:
        """``(doc_id, term, tf, weight)``; terms outside the vocabulary are ignored."""
        terms = doc_terms(docs, self.text_col, self.id_col, self.n_min, self.n_max,
                          self.tokenizer, self.stop)
        return tfidf_weights(term_counts(terms), self.vocab.select("term", "idf"), normalize)


def tfidf_weights(tf: DataFrame, vocab_idf: DataFrame, normalize: bool = True) -> DataFrame:
    return l2_weights(tf.join(vocab_idf, "term"), F.col("idf"), normalize)


def l2_weights(tf: DataFrame, idf: Column, normalize: bool = True) -> DataFrame:
    """``(doc_id, term, tf, weight)``; the weights are made after the exchange by document, which moves counts only."""
    weight = F.col("tf") * idf
    if normalize:
        tf = dealt_by(tf)
        weight = weight / F.sqrt(F.sum(weight * weight).over(Window.partitionBy("doc_id")))
    return tf.select("doc_id", "term", "tf", weight.alias("weight"))


class TfIdf:
    """Smoothed TF-IDF over n-grams, fitted on one set and applied to others.

    ``idf = ln((1 + n) / (1 + df)) + 1`` and rows are L2-normalised, the usual
    smoothed form. ``fit`` stays lazy: the vocabulary is a DataFrame.
    """

    def __init__(self, n_min: int = 1, n_max: int = 3, min_df: int = 1,
                 max_features: int | None = None, tokenizer=None, stop: bool = True,
                 text_col: str = "text", id_col: str = "doc_id"):
        self.n_min, self.n_max, self.min_df, self.max_features = n_min, n_max, min_df, max_features
        self.tokenizer, self.stop, self.text_col, self.id_col = tokenizer, stop, text_col, id_col

    def fit(self, docs: DataFrame) -> TfIdfModel:
        terms = doc_terms(docs, self.text_col, self.id_col, self.n_min, self.n_max,
                          self.tokenizer, self.stop)
        tf = term_counts(terms)
        n_docs = docs.select(F.count(F.lit(1))).scalar()
        vocab = build_vocab(tf, self.min_df, self.max_features) \
            .withColumn("idf", smooth_idf(F.col("df"), n_docs))
        return TfIdfModel(vocab, None, self.n_min, self.n_max, self.tokenizer, self.stop,
                          self.text_col, self.id_col)

    def fit_transform(self, docs: DataFrame, normalize: bool = True) -> DataFrame:
        """Fit and apply on the same documents, sharing the tf table.

        Texts move once by document; the counted terms move once by term, where a window counts
        their documents, and once back for the norm. Only ``max_features`` needs a vocabulary apart.
        """
        n_docs = docs.select(F.count(F.lit(1))).scalar()
        docs = by_document(docs, self.text_col, id_col=self.id_col)
        terms = doc_terms(docs, self.text_col, self.id_col, self.n_min, self.n_max,
                          self.tokenizer, self.stop)
        tf = term_counts(terms)
        if self.max_features is None:
            known = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term"))) \
                .filter(F.col("df") >= self.min_df)
            return l2_weights(known, smooth_idf(F.col("df"), n_docs), normalize)
        # The filter is always true; it keeps the counts in the vocabulary's branch, so
        # both branches need the same exchange of tf and Spark runs it once.
        vocab = build_vocab(tf, self.min_df, self.max_features).filter(F.col("cf") >= 1) \
            .select("term", smooth_idf(F.col("df"), n_docs).alias("idf"))
        return tfidf_weights(tf, vocab, normalize)


# --- padded token ids and embeddings -----------------------------------------

def kept_token_table(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     stop: bool = True, tokenizer=None) -> DataFrame:
    """``(doc_id, pos, token)``: kept tokens with 0-based positions. A document
    without kept tokens keeps one row with NULL ``pos``/``token``."""
    toks = tokenizer(F.col(text_col)) if tokenizer is not None else filtered_tokens(text_col, stop)
    return (docs.select(F.col(id_col).alias("doc_id"), toks.alias("_toks"))
            .select("doc_id", F.posexplode_outer("_toks").alias("pos", "token")))


def pad_ids(arr, length: int) -> Column:
    """Pad with 0 or cut to ``length``, both at the front (the end of the text is kept)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    n = F.size(a)
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.lit(length) - n)),
                    F.slice(a, F.greatest(F.lit(1), n - length + 1), length))


def tokens_to_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(doc_id, ids)``: each token's vocabulary id in text order, 0 when unknown.

    A document's occurrences of a token travel as one row with their positions, so
    what meets on a hot token is at most one row a document; documents without tokens
    stay out of the join. AQE broadcasts a small vocabulary, else it splits hot tokens.
    """
    v = vocab.select(F.col("term").alias("token"), F.col("id").cast("bigint").alias("_id"))
    pairs = (tokens.filter(F.col("token").isNotNull()).groupBy("doc_id", "token")
             .agg(F.collect_list("pos").alias("_at")))
    known = pairs.join(v, "token", "left").select("doc_id", F.transform("_at", lambda p: F.struct(
        p.alias("pos"), F.coalesce("_id", F.lit(0)).cast("bigint").alias("id"))).alias("_i"))
    none = F.array().cast(known.schema["_i"].dataType)
    empty = tokens.filter(F.col("token").isNull()).select("doc_id", none.alias("_i"))
    return (known.unionByName(empty).groupBy("doc_id")
            .agg(F.sort_array(F.flatten(F.collect_list("_i"))).alias("_s"))
            # exploded, so that whoever names the ids does not sort them again
            .select("doc_id", F.explode(F.array(F.transform("_s", lambda x: x["id"]))).alias("ids")))


@dataclass
class PadIdsModel:
    vocab: DataFrame          # (term, id), ids 1..V in alphabetical order
    pad_length: int
    stop: bool = True
    text_col: str = "text"
    id_col: str = "doc_id"
    tokenizer: object = None

    def transform(self, docs: DataFrame, remove_junk: bool | None = None) -> DataFrame:
        """``(doc_id, ids)`` padded/cut to ``pad_length``.

        ``remove_junk=False`` keeps stop words and junk tokens in the sequence (as ids when
        known, else 0); by default they go as they did when fitting.
        """
        tok = self.tokenizer
        if remove_junk is False:
            def tok(text):
                return tokenize(F.lower(text))
        toks = kept_token_table(dealt_by(docs, self.id_col), self.text_col, self.id_col, self.stop, tok)
        ids = tokens_to_ids(toks, self.vocab)
        return ids.select("doc_id", F.explode(F.array(pad_ids("ids", self.pad_length))).alias("ids"))

    def embeddings(self, vectors: DataFrame, key: str = "term", vector_col: str = "vector",
                   dim: int | None = None) -> DataFrame:
        return embed_vocab(self.vocab, vectors, key, vector_col, dim)


class PadIds:
    """Vocabulary of kept unigrams (ids 1..V, 0 = unknown/pad) and a pad length
    (the longest kept-token document of the fitting set unless given)."""

    def __init__(self, pad_length: int | None = None, stop: bool = True,
                 text_col: str = "text", id_col: str = "doc_id", tokenizer=None):
        self.pad_length, self.stop, self.text_col, self.id_col = pad_length, stop, text_col, id_col
        self.tokenizer = tokenizer

    def fit(self, docs: DataFrame) -> PadIdsModel:
        toks = kept_token_table(docs, self.text_col, self.id_col, self.stop, self.tokenizer)
        vocab = alphabetical_ids(toks.filter(F.col("token").isNotNull())
                                 .select(F.col("token").alias("term")).distinct())
        length = self.pad_length
        if length is None:
            own = (self.tokenizer(F.col(self.text_col)) if self.tokenizer is not None
                   else filtered_tokens(self.text_col, self.stop))
            length = docs.select(F.max(F.size(own))).first()[0]
        return PadIdsModel(vocab, int(length or 0), self.stop, self.text_col, self.id_col, self.tokenizer)


def embed_vocab(vocab: DataFrame, vectors: DataFrame, key: str = "term",
                vector_col: str = "vector", dim: int | None = None) -> DataFrame:
    """``(term, id, vector, has_vector)`` for vocabulary terms only; zeros when absent."""
    if dim is None:
        dim = vectors.select(F.size(vector_col)).first()[0]
    vec = vectors.select(F.col(key).alias(key), F.col(vector_col).cast("array<float>").alias("_v"))
    j = vocab.join(vec, key, "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), int(dim))
    return j.select("term", "id", F.coalesce("_v", zeros).alias("vector"),
                    F.col("_v").isNotNull().alias("has_vector"))


def pool_embeddings(ids: DataFrame, emb: DataFrame, dim: int) -> DataFrame:
    """Global max pooling per document over the vectors of its ids (id 0 = zero vector).

    Each distinct known id of a document is joined to its vector once. Id 0 (padding and
    unknown, in nearly every document) has no vector and stays out of the join: its zero
    vector is added per document. One aggregation computes every dimension.
    """
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    d = ids.select("doc_id", F.explode(F.array_distinct("ids")).alias("id")).filter(F.col("id") != 0)
    e = emb.select("id", F.col("vector").alias("_v"))
    j = d.join(e, "id", "left").select("doc_id", F.coalesce("_v", zeros).alias("_v"))
    padded = ids.filter(F.array_contains("ids", F.lit(0).cast("bigint"))).select("doc_id", zeros.alias("_v"))
    cols = [F.max(F.col("_v")[i]).alias(f"_d{i}") for i in range(dim)]
    return j.unionByName(padded).groupBy("doc_id").agg(*cols).select(
        "doc_id", F.array(*[F.col(f"_d{i}") for i in range(dim)]).alias("pooled"))

"""The registered queries of the training-data operators.

Each is thin: it applies one operator to its whole table and derives the columns
of its result from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.llm import ann, divergence, lexical, mixing, near_dup, packing, page_text, quality, secrets, sharding, topk, toxicity, winnow
from revspark.llm.common import held_out, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curriculum mix of all documents: words taken of each, first training position."""
    mix = mixing.assign_positions(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    first = F.round(F.get("copies", F.lit(0))["position"], 6)
    return (mix.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
                       first.alias("position"), "h")
            .orderBy(F.col("position").asc_nulls_last(), "h").drop("h"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform shuffle of all documents into 24 shards, counts at most one apart."""
    out = sharding.shuffle_into_shards(read_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    out = page_text.extract_text(pages, page_text.train(pages), keep=["page_id", "url"])
    return out.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text",
                      F.length("text").cast("long").alias("n_chars"))


@query
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every fiftieth vector among all vectors."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vid") % 50 == 0, 5)


@query
def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at shingle similarity 0.8."""
    return near_dup.linked_documents(read_table(spark, sf_dir, "documents"))


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every hundredth vector against all vectors."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vid") % 100 == 0, 10)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    pieces = packing.cut_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place_pieces(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                               "sequence_id", "offset", "class")


def _joined(spans):
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from co-trained text and metadata views."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "text_score", "meta_score")


@query
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence between the sources of each language over all documents."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words in every document."""
    found = winnow.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

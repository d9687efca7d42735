"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over training time 0..1 (piecewise linear).
Its integral says how many words the source has been asked for by any time;
inverting that cumulative demand at a document's own place in its source gives
the document's training position. Copies whose demand is never reached (place
beyond the source's target) are not taken; the rest, range-sorted by position,
is the training order.

Rows are ranked by an MD5 of id and size, so reruns agree. Sums are kept per
(source, hash bucket); a source that holds most rows is spread over as many
buckets as its rows need.

Defined results: null text has size 0, is never cut and takes 0 words; a null
source is one source of its own, last in order; fully repeated rows are
separate documents; an empty table gives an empty mix. Only the named columns
are read, the input's own columns travel inside one struct, so any extra column
name is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Rows a hash bucket of one source holds on average.
BUCKET_ROWS = 4096


@dataclass(frozen=True)
class Curriculum:
    """Weights by source rank (repeating) and their shape over training time.

    ``shapes`` are knots (time, factor), from time 0 to 1, also repeating by rank.
    ``share`` is the mix's size over the input's; ``max_passes`` caps a source.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    shapes: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
    share: float = 1.5
    max_passes: int = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _integrals(knots) -> tuple[float, list[tuple[float, float, float, float, float]]]:
    """Whole integral of a schedule; per segment (integral before, t0, w0, slope, w1)."""
    total, segments = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        segments.append((total, t0, w0, (w1 - w0) / (t1 - t0), w1))
        total += (w0 + w1) / 2 * (t1 - t0)
    return total, segments


def demand_time(share: Column, rank: Column, shapes) -> Column:
    """Time at which a source of this rank has been asked for ``share`` of its target."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(shapes):
        total, segments = _integrals(knots)
        x = share * F.lit(total)
        at = F.lit(None).cast("double")
        for before, t0, w0, slope, _ in segments:
            y = x - F.lit(before)
            inside = F.lit(t0) + F.lit(2.0) * y / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2.0 * slope) * y))
            at = F.when(y >= 0, inside).otherwise(at)
        out = F.when(rank % len(shapes) == i, at).otherwise(out)
    return out


def source_targets(sums: DataFrame, plan: Curriculum) -> DataFrame:
    """Target words per source by water filling: least(cap, weight * level).

    ``sums`` has one row per source (skey, source, size). The level is the largest of
    the candidate levels got by capping the sources of smallest cap per weight first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(int(w)) for w in plan.weights])
    s = (sums.withColumn("rank", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.element_at(weights, (F.col("rank") % len(plan.weights) + 1).cast("int")))
         .withColumn("cap", (F.col("size") * plan.max_passes).cast("double")))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    budget = F.sum("size").over(every) * F.lit(plan.share)
    level = ((budget - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    return (s.withColumn("level", level).withColumn("level", F.max("level").over(every))
            .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.col("level")))
            .select("skey", "rank", F.col("size").alias("source_size"), "target"))


def assign_positions(docs: DataFrame, plan: Curriculum = Curriculum(), *, id_col: str = "doc_id",
                     text_col: str = "text", source_col: str = "source", keep: list[str] | None = None,
                     seed: str = "mix") -> DataFrame:
    """One row per document: ``row`` (struct of ``keep``, default all columns), ``size``,
    ``source_size``, ``target``, ``taken`` and ``copies``, an array of (position, words),
    one entry per pass the mix takes, the last one possibly cut to the words still asked for.
    """
    kept = F.struct(*[F.col(c) for c in (keep or docs.columns)])
    n = docs.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    size = word_count(F.col(text_col))
    rows = (docs.select(kept.alias("row"), F.col(id_col).cast("string").alias("_id"),
                        F.col(source_col).alias("source"), size.alias("size"))
            .withColumn("h", F.md5(F.concat(F.coalesce("_id", F.lit("~")), F.lit(":"), F.col("size").cast("string"),
                                            F.lit(":" + seed)).cast("binary")))
            .withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")))
            .withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 12), 16, 10).cast("double")
                                          / F.lit(float(1 << 48)) * buckets).cast("long")))
    # one row per source and bucket: about n / BUCKET_ROWS rows a large source
    sums = staged(rows.groupBy("skey", "bucket").agg(F.first("source").alias("source"),
                                                     F.sum("size").alias("size")), "mix-sums")
    targets = source_targets(sums.groupBy("skey").agg(F.first("source").alias("source"),
                                                      F.sum("size").alias("size")), plan)
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sums.select("skey", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
               .join(targets, "skey"))
    local = Window.partitionBy("skey", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("inside", F.coalesce(F.sum("size").over(local), F.lit(0)))
              .join(offsets, ["skey", "bucket"])
              .withColumn("want", F.floor(F.col("target") + 0.5).cast("long")))
    copies = []
    for p in range(plan.max_passes):
        start = F.col("before") + F.col("inside") + F.col("source_size") * p
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("want") - start)).cast("long")
        at = demand_time(F.try_divide(start, F.col("want")), F.col("rank"), plan.shapes)
        copies.append(F.when(words > 0, F.struct(at.alias("position"), words.alias("words"))))
    return (placed.withColumn("copies", F.array_compact(F.array(*copies)))
            .withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
            .select("row", "size", "source_size", "target", "taken", "copies", "h"))


def training_order(assigned: DataFrame) -> DataFrame:
    """Taken copies, range-sorted by position: ``position``, ``words``, ``size``, ``row``."""
    out = assigned.select("row", "size", "h", F.explode("copies").alias("c"))
    return (out.select(F.col("c.position").alias("position"), F.col("c.words").alias("words"), "size", "row", "h")
            .orderBy("position", "h").drop("h"))


def mixed_documents(docs: DataFrame, plan: Curriculum = Curriculum(), *, text_col: str = "text") -> DataFrame:
    """The mix as documents, in training order: a repeated document is a repeated row.

    The one document per source at which the target is reached keeps only the words
    still asked for, joined by single spaces; every other text is untouched.
    """
    rows = training_order(assign_positions(docs, plan, text_col=text_col))
    text = F.col(f"row.`{text_col}`")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    new_text = F.when(F.col("words") < F.col("size"), cut).otherwise(text)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(new_text.alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("words") < F.col("size"), F.length(cut))
                        .otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return rows.select(*cols)

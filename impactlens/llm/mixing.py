"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.llm.shared import boxed, running, same, unboxed, whole
from impactlens.session import materialise

#: A word is a run of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of non-space characters; each run, with the space before it, becomes one letter that is then counted."""
    spaced = F.regexp_replace(text, r"[\x20\x09-\x0D]*" + WORD, "w")
    return F.length(F.regexp_replace(spaced, r"[\x20\x09-\x0D]+$", "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: int) -> DataFrame:
    """(source, source_size, weight, source_rank, target) from (source, size).

    Targets are ``least(max_repeats * source_size, level * weight)``. Over the sources in the order of
    their cap per weight, the level is the largest of (total - caps before) / (weights from here on), so
    one pass replaces the rounds of handing the excess on.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One letter in front makes null the last source.
    per = per.withColumn("_key", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = running(per, [], [F.col("_key")]).withColumnRenamed("rn", "source_rank")
    per = per.withColumn("weight", listed[F.pmod(F.col("source_rank") - 1, F.lit(len(weights))).cast("int")])
    per = per.withColumn("_cap", F.col("source_size").cast("double") * max_repeats).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    capped = running(per, [], [F.col("_ratio"), F.col("source_rank")], "_cap").drop("rn").withColumnRenamed("upto", "_caps")
    placed = materialise(running(capped, [], [F.col("_ratio"), F.col("source_rank")], "weight").withColumnRenamed("upto", "_weights"))
    total, heavy = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, heavy = (total or 0) * share, heavy or 0.0
    left = F.lit(heavy) - F.col("_weights") + F.col("weight")
    level = placed.agg(F.max((F.lit(float(total)) - F.col("_caps") + F.col("_cap")) / left)).first()[0] or 0.0
    return placed.select("source", "source_size", "weight", "source_rank", F.least("_cap", F.lit(level) * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    max_repeats: int = 3,
    seed: int = 17,
) -> DataFrame:
    """The copies of documents that the mix takes, in its order.

    Every source queues its shuffled documents, again and again up to ``max_repeats`` times. A copy's virtual
    finish time is its source's words so far, its own included, over the source's weight; all copies are range-sorted
    by it and the mix ends at the budget (``share`` of all words). When it ends, every source has one document in
    service, which counts with the words served by then, so each source gets its target to the word.

    Returns one row per copy and at least one per document: (doc_id, source, size, source_size, target, source_rank,
    place, pass, finish, offset, words, digest). ``words`` is 0 for documents that the mix leaves out. Null texts have no words;
    a null source is the last source; sources with no words get nothing; repeated rows are documents of their own and
    equal keys are ordered by size.
    """
    sizes = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(whole(text_col)).alias("size"), F.xxhash64(whole(text_col)).alias("digest")))
    shares = targets(sizes, weights, share, max_repeats)
    budget = F.lit((sizes.agg(F.sum("size")).first()[0] or 0) * share)
    shuffled = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("size"), F.col("digest")]
    queued = same(running(sizes, ["source"], shuffled, "size").withColumnRenamed("rn", "place"), shares, ["source"])
    passes = F.greatest(F.coalesce(F.ceil(F.col("target") / F.col("source_size")), F.lit(1)), F.lit(1)).cast("int")
    copies = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    start = F.col("pass") * F.col("source_size") + F.col("upto") - F.col("size")
    served = F.least(F.col("size"), F.greatest(F.lit(0), F.floor(F.col("target") + 1e-6) - start))
    copies = copies.withColumn("finish", (start + F.col("size")) / F.col("weight")).withColumn("_served", served.cast("long")).drop("upto")
    ordered = running(copies, [], [F.col("finish"), F.col("source_rank"), F.col("place"), F.col("pass")], "_served")
    words = F.least(F.col("_served"), F.greatest(F.lit(0), F.ceil(budget) - F.col("upto") + F.col("_served"))).cast("long")
    return ordered.select(
        "doc_id", "source", "size", "source_size", "target", "source_rank", "place", "pass", "finish", (F.col("upto") - F.col("_served")).alias("offset"), words.alias("words"), "digest"
    )


def taken_per_document(copies: DataFrame) -> DataFrame:
    """One row per document: words taken over all its copies, and how often it is begun."""
    return copies.groupBy("source_rank", "place", "doc_id", "size", "source_size", "target").agg(
        F.sum("words").alias("taken"), F.sum((F.col("words") > 0).cast("int")).alias("copies"), F.min("finish").alias("first_finish")
    ).drop("source_rank", "place")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, a row for each copy of which at least half is taken; columns as they came.

    Documents without words have no share of a mix and go. Rows of one id, source and text are interchangeable: together they
    get the copies that the mix takes of them, one at most apart. Rows that share an id (null too) but not the text keep each their own.
    """
    id_col, source_col, text_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text")))
    chosen = mix(docs, **options).withColumn("_whole", ((F.col("words") > 0) & (2 * F.col("words") >= F.col("size"))).cast("int"))
    per = chosen.groupBy("doc_id", "source", "digest").agg(F.sum("_whole").alias("_copies"), F.sum((F.col("pass") == 0).cast("int")).alias("_rows"))
    per = per.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("digest").alias("_digest"), "_copies", "_rows").filter("_copies > 0")
    rows = boxed(docs, _id=F.col(id_col), _source=F.col(source_col).cast("string"), _digest=F.xxhash64(whole(text_col)))
    joined = materialise(same(rows, per, ["_id", "_source", "_digest"], "inner"))
    share = F.expr("_copies div _rows")
    even = joined.filter("_copies % _rows = 0").select("_row", share.alias("_times"))
    # Only rows that cannot share evenly are numbered, in a drawn order, by which the range partitions can part them.
    drawn = materialise(joined.filter("_copies % _rows > 0").withColumn("_draw", F.rand(options.get("seed", 17))))
    numbered = running(drawn, ["_id", "_source", "_digest"], [F.col("_draw")])
    uneven = numbered.select("_row", (share + (F.col("rn") <= F.col("_copies") % F.col("_rows")).cast("int")).alias("_times"))
    times = even.unionByName(uneven).filter("_times > 0")
    return unboxed(times.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))))

"""Document fingerprints: a Merkle tree over sections and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactlens.llm.shared import whole

#: Low bits of a leaf's digest that hold its weight, its number of words.
WEIGHT_BITS = 12
#: Range buckets at most when every document meets the one after it.
MAX_BUCKETS = 1024


def paragraph_digests(text: Column) -> Column:
    """Sections (between empty lines) of paragraphs (lines), as nested arrays of digests. Joining them back gives the text, so no two texts share a tree."""
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.sha2(F.concat(F.lit("p"), p), 256)))


def section_digests(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda ps: F.sha2(F.concat(F.lit("s"), F.concat_ws("", ps)), 256))


def root_digest(sections: Column) -> Column:
    return F.sha2(F.concat(F.lit("r"), F.concat_ws("", sections)), 256)


def _ends(hashes: Column) -> Column:
    """Places (from 1) of the words that end a leaf."""
    top = F.lit(2**63 - 1)

    def ends(i: Column) -> Column:
        own = F.get(hashes, i - 1)
        lowest = (own <= F.coalesce(F.get(hashes, i - 2), top)) & (own <= F.coalesce(F.get(hashes, i), top))
        return lowest | (own.bitwiseAND(1) == 1) | (i == F.size(hashes))

    return F.filter(F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.size(hashes))).otherwise(F.array().cast("array<int>")), ends)


def _leaves(hashes: Column, ends: Column) -> Column:
    def leaf(end: Column, i: Column) -> Column:
        n = end - F.coalesce(F.get(ends, i - 1), F.lit(0))
        digest = F.xxhash64(F.slice(hashes, end - n + 1, n))
        return digest.bitwiseAND(-(1 << WEIGHT_BITS)).bitwiseOR(F.least(n, F.lit((1 << WEIGHT_BITS) - 1)).cast("long"))

    return F.array_distinct(F.transform(ends, leaf))


def with_leaves(docs: DataFrame, **texts: Column) -> DataFrame:
    """Adds per named text the leaves of its paragraphs, each once, as digests with their weight in the low bits.

    A leaf ends with its line and at a word whose hash is not above its neighbours', so an inserted word changes the leaves around it only.
    """
    # The lowest bit of a word's hash says that the word ends its line. Columns of their own, so that no lambda computes an array again.
    words = {f"_words_{name}": F.regexp_extract_all(text, F.lit(r"\S++(?:[^\S\n]*+\n)?+"), F.lit(0)) for name, text in texts.items()}
    hashed = docs.withColumns({
        name: F.transform(found, lambda w: F.xxhash64(w).bitwiseAND(-2).bitwiseOR(F.endswith(w, F.lit("\n")).cast("long"))) for name, found in words.items()
    })
    cut = hashed.withColumns({f"_ends_{name}": _ends(F.col(f"_words_{name}")) for name in texts})
    done = cut.withColumns({name: _leaves(F.col(f"_words_{name}"), F.col(f"_ends_{name}")) for name in texts})
    return done.drop(*words, *[f"_ends_{name}" for name in texts])


def weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda total, x: total + x.bitwiseAND((1 << WEIGHT_BITS) - 1))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots, else the weight of the leaves that both trees hold, over the weight of all leaves of both."""
    both = weight(leaves_a) + weight(leaves_b)
    return F.when(root_a == root_b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2 * weight(F.array_intersect(leaves_a, leaves_b)) / both)


def differing_branches(pairs: DataFrame, key: str, text_a: str, text_b: str) -> DataFrame:
    """(key, side, section, paragraph, digest): every paragraph of either text whose digest the other text does not hold.

    Branches are aligned by digest, so what merely moved is equal; places count from 0, side is ``a`` or ``b``. Each key is one pair; null texts are empty.
    """
    sides = []
    for side, text in (("a", text_a), ("b", text_b)):
        sections = pairs.select(F.col(f"`{key}`").alias("_key"), F.posexplode(paragraph_digests(whole(F.col(f"`{text}`")))).alias("section", "_paragraphs"))
        sides.append(sections.select("_key", F.lit(side).alias("side"), "section", F.posexplode("_paragraphs").alias("paragraph", "digest")))
    places = F.collect_list(F.struct("side", "section", "paragraph"))
    own = sides[0].unionByName(sides[1]).groupBy("_key", "digest").agg(places.alias("_at"), F.min("side").alias("_low"), F.max("side").alias("_high")).filter("_low = _high")
    return own.select("_key", "digest", F.explode("_at").alias("_at")).select(F.col("_key").alias(key), "_at.*", "digest")


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first branch that differs; null for equal arrays."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.nullif(F.array_position(equal, False), F.lit(0)) - 1


def fingerprints(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``paragraphs``, ``sections``, ``fingerprint`` and ``leaves`` of a text (null: empty)."""
    trees = docs.withColumn("paragraphs", paragraph_digests(whole(text))).withColumn("sections", section_digests(F.col("paragraphs")))
    return with_leaves(trees.withColumn("fingerprint", root_digest(F.col("sections"))), leaves=whole(text))


def _bucket(key: Column, bounds: list) -> Column:
    """Bounds not above the key, in two steps over about the root of their number; null keys come before all."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    step = max(1, round(len(bounds) ** 0.5))
    blocks = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    passed = F.size(F.filter(blocks, lambda block: block[0] <= key))
    inner = F.when(passed == 0, 0).otherwise((passed - 1) * step + F.size(F.filter(F.get(blocks, passed - 1), lambda b: b <= key)))
    return F.when(key.isNull(), -1).otherwise(inner)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, next_text): the text after it in descending order of the id, the first one's after the last.

    Buckets of ids come from quantiles; the first document of each bucket is also put behind the last of the bucket
    before it, so each text is shuffled once and no task holds more than a bucket. Null ids are last; rows of one id
    are ordered by text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    ids = rows.select("doc_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MAX_BUCKETS, max(2, parts))
    bounds = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)])).first()[0] or []
    bucket = _bucket(F.col("doc_id"), sorted(set(bounds)))
    heads = {r[0]: r[1] for r in ids.groupBy(bucket.alias("b")).agg(F.max("doc_id")).collect()}
    order = sorted(heads, reverse=True)
    behind = [(heads[b], order[i - 1]) for i, b in enumerate(order)]
    ghosts = docs.sparkSession.createDataFrame(behind, f"_head {dict(rows.dtypes)['doc_id']}, _behind INT")
    # At most one row per bucket, so never more than MAX_BUCKETS + 1.
    both = rows.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    places = F.filter(F.array(F.struct(bucket.alias("b"), F.lit(False).alias("ghost")), F.struct(F.col("_behind").alias("b"), F.lit(True).alias("ghost"))), lambda x: x["b"].isNotNull())
    dealt = both.withColumn("_at", F.explode(places)).select("doc_id", "text", F.col("_at.b").alias("_bucket"), F.col("_at.ghost").alias("_ghost"))
    order_by = W.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), F.col("text"))
    ranged = dealt.repartitionByRange(n, "_bucket")
    return ranged.withColumn("next_text", F.lead("text").over(order_by)).filter(~F.col("_ghost")).drop("_bucket", "_ghost")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (the last third replaced by the next document's start) and their likeness.

    Null texts are empty; equal texts have equal fingerprints; a lone document is its own next one.
    ``first_section`` and ``first_paragraph`` (from 0) are where the two trees first differ, null if nowhere.
    """
    pairs = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    edited = with_leaves(edited, wa=F.col("text"), we=F.col("edited"), wn=F.col("next_text"))
    trees = edited.select("*", paragraph_digests(F.col("text")).alias("pa"), paragraph_digests(F.col("edited")).alias("pe"), paragraph_digests(F.col("next_text")).alias("pn"))
    trees = trees.select("*", *[section_digests(F.col(f"p{x}")).alias(f"s{x}") for x in "aen"])
    trees = trees.select(
        "doc_id", "n_chars", "pa", "pe", "sa", "se", "wa", "we", "wn", F.sha2("edited", 256).alias("edited_sha256"), *[root_digest(F.col(f"s{x}")).alias(f"r{x}") for x in "aen"],
    ).withColumn("first_section", first_difference(F.col("sa"), F.col("se")))
    at = F.col("first_section").cast("int")
    return trees.select(
        "doc_id", "n_chars", "edited_sha256", F.col("ra").alias("fingerprint"), F.col("re").alias("edited_fingerprint"),
        likeness(F.col("ra"), F.col("wa"), F.col("re"), F.col("we")).alias("near_edited"),
        likeness(F.col("ra"), F.col("wa"), F.col("rn"), F.col("wn")).alias("near_next"),
        "first_section", first_difference(F.get("pa", at), F.get("pe", at)).alias("first_paragraph"),
    )

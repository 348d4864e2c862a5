"""Near-duplicate documents by ProbMinHash, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactlens.llm.shared import boxed, chunks, components, same, unboxed, whole
from impactlens.llm.words import mix64, shingles
from impactlens.session import materialise

#: 28 bands of 6 registers: two texts with a similarity of 0.8 share no band once in 5,000 times, as all shingles weigh the same.
BANDS, ROWS = 28, 6
THRESHOLD = 0.8
_U = np.uint64


def prob_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n texts, m registers) of weighted sets, sorted by text; texts without elements keep zeros.

    Each element sends points of a Poisson process with its weight as the rate; a point falls on a random register,
    and a register keeps the element whose point came first. Points come in rounds over all elements, and an element
    stops as soon as its next point is later than every register of its text. Two texts agree in a register with
    the probability Jaccard similarity of their weighted sets.
    """
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    live = np.arange(len(element))
    clock = np.zeros(len(element))
    latest = np.full(n, np.inf)
    drawn, block = 0, 1
    while len(live):
        steps = np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)
        bits = mix64(element[live][:, None] + steps[None, :])
        gaps = -np.log((np.right_shift(bits, _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live][:, None]
        times = clock[live][:, None] + np.cumsum(gaps, axis=1)
        register = (mix64(bits ^ _U(0xA0761D6478BD642F)) % _U(m)).astype(np.int64) + (text[live] * m)[:, None]
        clock[live] = times[:, -1]
        useful = times <= latest[text[live]][:, None]
        at, when = register[useful], times[useful]
        who = np.broadcast_to(element[live][:, None], times.shape)[useful]
        np.minimum.at(first, at, when)
        won = first[at] == when
        winner[at[won]] = who[won]
        latest = first.reshape(n, m).max(axis=1)
        live = live[clock[live] <= latest[text[live]]]
        drawn += block
        block = min(64, block * 2)
    return winner.reshape(n, m)


def band_keys(texts: list[str]) -> tuple[list, np.ndarray]:
    """The band keys of every text (None for a text without words) and its number of shingles."""
    text, element, _ = shingles(texts)
    # Links are decided by sets. With one weight for all, and only then, registers agree with the similarity of the sets.
    signature = prob_minhash(text, element, np.ones(len(element)), len(texts), BANDS * ROWS)
    grouped = signature.reshape(len(texts), BANDS, ROWS)
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix64(keys + grouped[:, :, r] * _U(2 * r + 3) + _U(r))
    keys = mix64(keys + np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)
    sizes = np.bincount(text, minlength=len(texts))
    return [keys[i] if sizes[i] else None for i in range(len(texts))], sizes


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch.pop("text").tolist()
        bands: list = []
        sizes: list = []
        for a, b in chunks(texts):
            keys, counts = band_keys(texts[a:b])
            bands += keys
            sizes += counts.tolist()
        yield batch.assign(size=sizes, bands=bands)


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Jaccard similarity of the shingle sets of left[i] and right[i]; 0 where either has no words."""
    n = len(left)
    text, element, _ = shingles([*left, *right])
    side, pair = text >= n, text % n
    sizes = np.bincount(text, minlength=2 * n)
    order = np.lexsort((side, element, pair))
    p, e = pair[order], element[order]
    both = (p[1:] == p[:-1]) & (e[1:] == e[:-1])
    common = np.bincount(p[1:][both], minlength=n)
    total = sizes[:n] + sizes[n:] - common
    return np.where(total > 0, common / np.maximum(total, 1), 0.0)


def _similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in parts:
        a, b = left.tolist(), right.tolist()
        out = [similarities(a[i:j], b[i:j]) for i, j in chunks(a, 1 << 19)]
        yield pd.Series(np.concatenate(out) if out else np.zeros(0))


def _shingle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, numbers = batch["text"].tolist(), batch["number"].to_numpy()
        for a, b in chunks(texts):
            text, element, _ = shingles(texts[a:b])
            yield pd.DataFrame({"number": numbers[a:b][text], "shingle": element.view(np.int64)})


def node_of(text: Column) -> Column:
    """A text's identity: 128 bits of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds the exact similarity to the distinct pairs (a, b)."""
    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("_tb")), "b")
    return materialise(full.select("a", "b", F.pandas_udf(_similarity, "double")("_ta", "_tb").alias("sim")))


def _ordered(left: Column, right: Column) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def near_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, class_id, class_size, class_texts, kept): classes of documents chained by similarities of ``threshold`` or more.

    Equal texts count once. Bands propose; the Jaccard similarity of the sets of five-word shingles decides. In each band
    bucket all texts are first compared with one drawn text, in every band another, and then with the one in the middle, which finds the
    class of nearly all with a number of pairs that grows with the texts. What is still apart from the largest class of a bucket is
    compared with all of that bucket, unless the shingles that a text shares with no other rule the threshold out, so no link between different
    classes is lost.

    ``class_id`` is the smallest id of a class and ``kept`` marks the row with it (repeated rows of that id and text: each). Null ids
    come last. Null and empty texts, and texts without words, have no shingles and are near only to equal texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("node", node_of(F.col("text")))
    fields = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = materialise(rows.mapInPandas(_signatures, fields))
    nodes = signed.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    placed = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = materialise(placed.join(crowded, "bucket", "left_semi"))
    wanted = members.select("node").distinct()
    # Written before copies are made one, so that a text with very many copies can be split over tasks.
    copies = materialise(rows.select("node", "text").join(wanted, "node", "left_semi"))
    texts = materialise(copies.groupBy("node").agg(F.first("text").alias("text")).withColumn("number", F.monotonically_increasing_id()))

    def checked_against(pivots: DataFrame, candidates: DataFrame, done: DataFrame | None) -> DataFrame:
        """The similarities of all candidates to the pivot of their bucket, but for pairs already done."""
        pairs = candidates.join(pivots, "bucket").filter("node <> pivot").select(*_ordered(F.col("node"), F.col("pivot"))).distinct()
        return _verified(pairs if done is None else pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), texts)

    def still_open(links: DataFrame) -> DataFrame:
        """The members of the buckets that hold several classes, each with its root and that of the bucket's largest class."""
        labelled = members.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        per = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        largest = per.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
        return materialise(labelled.join(largest, "bucket").select("bucket", "node", "size", "root", "main"))

    drawn = members.groupBy("bucket").agg(F.min_by("node", F.struct(F.xxhash64("node", "bucket"), F.col("node"))).alias("pivot"))
    checked = checked_against(drawn, members, None)
    divided = still_open(checked.filter(F.col("sim") >= threshold))

    # Shingles that no other text of a divided bucket has are in no intersection, which bounds every similarity from above.
    still = texts.join(divided.select("node").distinct(), "node", "left_semi")
    alone = still.select("number", "text").mapInPandas(_shingle_rows, "number LONG, shingle LONG").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("number"))
    owned = alone.filter("n = 1").groupBy("number").agg(F.count(F.lit(1)).alias("own"))
    owned = materialise(still.select("node", "number").join(owned, "number").select("node", "own"))
    divided = materialise(divided.join(owned, "node", "left").withColumn("common", F.col("size") - F.coalesce("own", F.lit(0))))
    # The text with the smallest share of its own is the middle of its bucket: what is near to anything is most likely near to it.
    middle = divided.groupBy("bucket").agg(F.min_by(F.struct(F.col("node").alias("pivot"), F.col("root").alias("pivot_root")), F.struct(1 - F.col("common") / F.col("size"), F.col("node"))).alias("_m"))
    outside = divided.join(middle, "bucket").filter("root <> _m.pivot_root").select("bucket", "node")
    checked = checked.unionByName(checked_against(middle.select("bucket", "_m.pivot"), outside, checked))
    links = checked.filter(F.col("sim") >= threshold)

    common = still_open(links).join(divided.select("bucket", "node", "common"), ["bucket", "node"])
    # At most BANDS buckets per text; a pair is made in the first bucket that both are in.
    places = members.join(common.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_list("bucket").alias("places"))
    common = materialise(common.join(places, "node"))
    few = common.filter((F.col("root") != F.col("main")) & (F.col("common") >= F.lit(threshold) * F.col("size"))).select(
        F.col("bucket").alias("_b"), F.col("node").alias("x"), F.col("root").alias("x_root"), F.col("size").alias("x_size"), F.col("common").alias("x_common"), F.col("places").alias("x_places"),
    )
    fits = F.least("common", "x_common") * (1 + threshold) >= F.lit(threshold) * (F.col("size") + F.col("x_size")) - 1e-6
    apart = (F.col("root") != F.col("x_root")) & fits & ((F.col("root") == F.col("main")) | (F.col("x") < F.col("node")))
    first = F.array_min(F.array_intersect("places", "x_places")) == F.col("bucket")
    rest = few.join(common, (F.col("bucket") == F.col("_b")) & apart & first)
    rest = rest.select(*_ordered(F.col("x"), F.col("node"))).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
    links = links.unionByName(_verified(rest, texts).filter(F.col("sim") >= threshold))

    classes = components(links)
    labelled = signed.select("doc_id", "node").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = materialise(labelled)
    per = labelled.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
    )
    texts_per = labelled.groupBy("root", "node").agg(F.lit(1).alias("_one")).groupBy("root").agg(F.count(F.lit(1)).alias("class_texts"))
    # The text of the smallest id decides between rows of that id.
    best = labelled.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("_first"))
    classed = labelled.join(per, "root").join(texts_per, "root").join(best, "root")
    first = F.col("_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_first.node") == F.col("node"))
    return classed.select("doc_id", "node", "class_id", "class_size", "class_texts", first.alias("kept"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size, class_texts, kept): the rows of ``near_nodes`` without their texts' identity."""
    return near_nodes(docs, id_col, text_col, threshold).drop("node")


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents whose row is kept; columns as they came. A row is its id and its text, as ids may be null or shared by different texts."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    gone = near_nodes(docs, **options).filter(~F.col("kept")).select("doc_id", "node").distinct()
    marked = boxed(docs, doc_id=F.col(id_col), node=node_of(whole(text_col)))
    return unboxed(same(marked, materialise(gone), ["doc_id", "node"], "left_anti"))

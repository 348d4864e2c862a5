"""Exact duplicate removal over a cuckoo-filter index of live digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.llm.shared import boxed, same, unboxed, whole
from impactlens.session import materialise

SLOTS = 4
MAX_KICKS = 200
_MASK = (1 << 64) - 1


def _scramble(x: int) -> int:
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & _MASK
    return x ^ (x >> 33)


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each in one of two buckets; knows inserted keys, forgets deleted ones.

    The 64-bit keys are kept beside the filter. When an insertion finds no place after ``MAX_KICKS`` moves, the
    table doubles and is filled again from the stored keys.
    """

    def __init__(self, buckets: int = 1024, keys: dict[int, int] | None = None):
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.keys: dict[int, int] = {}
        self.table = [0] * (self.buckets * SLOTS)
        self.resized = 0
        for key, copies in (keys or {}).items():
            self.insert(key, copies)

    def _places(self, key: int) -> tuple[int, int, int]:
        mixed = _scramble(key & _MASK)
        print_ = (mixed >> 48) or 1
        first = mixed & (self.buckets - 1)
        return print_, first, first ^ (_scramble(print_) & (self.buckets - 1))

    def _seat(self, print_: int, bucket: int) -> bool:
        start = bucket * SLOTS
        for i in range(start, start + SLOTS):
            if not self.table[i]:
                self.table[i] = print_
                return True
        return False

    def _place(self, key: int) -> bool:
        print_, first, second = self._places(key)
        if self._seat(print_, first) or self._seat(print_, second):
            return True
        bucket = second
        for kick in range(MAX_KICKS):
            at = bucket * SLOTS + (kick + print_) % SLOTS
            print_, self.table[at] = self.table[at], print_
            bucket ^= _scramble(print_) & (self.buckets - 1)
            if self._seat(print_, bucket):
                return True
        return False

    def __contains__(self, key: int) -> bool:
        print_, first, second = self._places(key)
        return print_ in self.table[first * SLOTS : first * SLOTS + SLOTS] or print_ in self.table[second * SLOTS : second * SLOTS + SLOTS]

    def insert(self, key: int, copies: int = 1) -> None:
        """Counts the key's live copies; only the first takes a slot."""
        live = self.keys.get(key, 0)
        self.keys[key] = live + copies
        if not live and not self._place(key):
            self._resize()

    def delete(self, key: int, copies: int = 1) -> None:
        """Takes copies back; the last one gives its slot free. Unknown keys are ignored."""
        live = self.keys.get(key)
        if live is None:
            return
        if live > copies:
            self.keys[key] = live - copies
            return
        del self.keys[key]
        print_, first, second = self._places(key)
        for bucket in (first, second):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[i] == print_:
                    self.table[i] = 0
                    return

    def _resize(self) -> None:
        placed = False
        while not placed:
            self.buckets *= 2
            self.resized += 1
            self.table = [0] * (self.buckets * SLOTS)
            placed = all(self._place(key) for key in self.keys)


INDEX = "shard INT, buckets LONG, keys BINARY, copies BINARY"


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up the keys of a batch, so a hot key leaves a task as one row per batch."""
    for batch in batches:
        yield batch.groupby(["key", "change"], as_index=False, sort=False)["copies"].sum()


def _hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys that their shard's filter had already seen when they came, or that came with several copies."""
    live = CuckooFilter()
    for batch in batches:
        hits = []
        for key, copies in zip(batch["key"].tolist(), batch["copies"].tolist(), strict=True):
            if copies > 1 or key in live:
                hits.append(key)
            live.insert(key, copies)
        yield pd.DataFrame({"key": np.array(hits, np.int64)})


def keys_of(rows: DataFrame, change: int = 1) -> DataFrame:
    """(key, change, copies) of rows with a ``key``: +1 adds, -1 takes back."""
    changes = rows.select("key", F.lit(change).alias("change"), F.lit(1).cast("long").alias("copies"))
    return changes.mapInPandas(_merged, "key LONG, change INT, copies LONG")


def dealt(changes: DataFrame, shards: int) -> DataFrame:
    return changes.repartition(shards, "key")


def update_index(index: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """The next version of an index (``INDEX`` rows): changes are added to, or taken back from, each shard's live keys.

    A shard holds the keys whose hash falls to it, as 64-bit numbers, and the size its filter had grown to.
    """
    rows = changes.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "change", "copies")
    rows = rows.groupBy("shard", "key").agg(F.sum(F.col("change") * F.col("copies")).alias("net"))
    stored = index if index is not None else rows.sparkSession.createDataFrame([], INDEX)

    def apply(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        live = CuckooFilter(int(old["buckets"].iloc[0]) if len(old) else 1024)
        for stored_keys, stored_copies in zip(old["keys"], old["copies"], strict=True):
            for k, c in zip(np.frombuffer(stored_keys, np.int64).tolist(), np.frombuffer(stored_copies, np.int64).tolist(), strict=True):
                live.insert(k, c)
        for k, net in zip(new["key"].tolist(), new["net"].tolist(), strict=True):
            if net > 0:
                live.insert(k, net)
            elif net < 0:
                live.delete(k, -net)
        keys, copies = np.array(list(live.keys), np.int64), np.array(list(live.keys.values()), np.int64)
        return pd.DataFrame({"shard": [key[0]], "buckets": [live.buckets], "keys": [keys.tobytes()], "copies": [copies.tobytes()]})

    return stored.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(apply, INDEX)


def probe(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """The rows (with a ``key``) that may equal a live text of the index; a hit must still be verified."""
    asked = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    distinct = asked.groupBy("shard", "key").agg(F.lit(1).alias("_one"))

    def look(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        live = CuckooFilter(int(old["buckets"].iloc[0]) if len(old) else 2)
        for stored in old["keys"]:
            for k in np.frombuffer(stored, np.int64).tolist():
                live.insert(k)
        return pd.DataFrame({"key": np.array([k for k in new["key"].tolist() if k in live], np.int64)})

    hits = index.groupBy("shard").cogroup(distinct.groupBy("shard")).applyInPandas(look, "key LONG")
    return rows.join(hits, "key", "left_semi")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): groups of identical texts; the row with the largest id stays.

    Keys (64 bits of the digest) go to the shards of a cuckoo filter, merged batch by batch. Only texts whose key was seen
    before are read again and compared byte by byte; their copies shrink to one row per task before they meet. All other
    texts never move. Null texts are empty, null ids count as smallest, and of repeated rows with the largest id one stays.
    """
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    # The number tells repeated rows apart; it is drawn once, as the rows are written.
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))
    key = F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long")
    keyed = rows.withColumn("key", key)
    shards = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hits = materialise(dealt(keys_of(keyed), shards).select("key", "copies").mapInPandas(_hits, "key LONG").distinct())
    suspects = docs.select(F.sha2(text, 256).alias("text_sha256"), text.alias("text")).withColumn("key", key).join(hits, "key", "left_semi")
    # Grouping by the text itself is the comparison of contents.
    equal = suspects.groupBy("text", "text_sha256").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("text_sha256", "copies")
    groups = keyed.join(hits, "key", "left_semi").groupBy("text_sha256").agg(F.max(F.struct("doc_id", "_row")).alias("_best")).join(equal, "text_sha256")
    groups = materialise(groups.select("text_sha256", F.col("_best.doc_id").alias("keep_id"), F.col("_best._row").alias("_keep_row"), F.col("copies").alias("group_size")))
    joined = rows.join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep_row"))).alias("kept"), "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of equal texts; columns as they came."""
    groups = materialise(exact_groups(docs, id_col, text_col).filter("group_size > 1"))
    # A row goes if its text has a kept row of another id; repeated rows of the kept id are made one.
    fates = groups.groupBy("doc_id", "text_sha256").agg(F.max(F.col("kept").cast("int")).alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    fates = materialise(fates.filter("_kept = 0 OR _rows > 1"))
    marked = boxed(docs, doc_id=F.col(id_col), text_sha256=F.sha2(whole(text_col), 256))
    key = ["doc_id", "text_sha256"]
    # Always merged, so that the plan does not change with the number of copies.
    rest = same(marked, fates.select(*key).hint("merge"), key, "left_anti")
    repeated = same(marked, fates.filter("_kept = 1").select(*key), key, "left_semi").dropDuplicates(key)
    return unboxed(rest.unionByName(repeated))

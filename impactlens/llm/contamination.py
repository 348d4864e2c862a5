"""Benchmark decontamination: a broadcast set of benchmark word windows, met by every window of the training texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from impactlens.llm.shared import boxed, chunks, running, whole
from impactlens.llm.words import mix64
from impactlens.session import materialise

#: Words in a window.
WINDOW = 10
#: Windows that one broadcast holds at most (about 30 bytes each), and the windows of one stored piece of an item.
MAX_WINDOWS, PIECE = 1 << 20, 1 << 14
_U = np.uint64
_SIEVE_BITS = 22
# A-Z become a-z, bytes of letters, digits and code points beyond ASCII stay, all others become a space.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normalised(text: str) -> bytes:
    """The UTF-8 text with A-Z lower-cased and a space for every byte outside words; as long as the text's bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word."""
    inside = np.frombuffer(data, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


_have: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _have.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _U(base), _U)
        steps[0] = 1
        have = _have[base] = np.cumprod(steps)
    return have[:n]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes as a difference of running sums, modulo 2^64."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((np.frombuffer(data, np.uint8).astype(_U) + _U(1)) * _powers(_BASE, len(data)), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _powers(_BACK, len(data))[starts] + (ends - starts).astype(_U))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words, by its first."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.full(n, _U(size))
    for j in range(size):
        total = total * _U(_BASE | 1) + mix64(hashes[j : j + n] + _U(j))
    return mix64(total)


def merged(spans: list[tuple[int, int]], n_words: int) -> list[tuple[int, int]]:
    """The stretches of words that lie in any of the spans (first, words), in order."""
    change = np.zeros(n_words + 1, np.int32)
    for first, n in spans:
        change[first] += 1
        change[first + n] -= 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(change) > 0)).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


class Windows:
    """The windows of benchmark pieces: sorted hashes, and the words behind each for the exact check."""

    def __init__(self, pieces: list[tuple[str, int, int, bytes]]):
        """From (item, window size, windows, words of the piece joined by a space)."""
        self.items = [p[0] for p in pieces]
        self.bodies = [p[3] for p in pieces]
        self.by_size = {}
        for size in sorted({p[1] for p in pieces}):
            found, piece, place = [], [], []
            for i, (_, width, _, body) in enumerate(pieces):
                if width == size:
                    h = window_hashes(word_hashes(body, *word_spans(body)), size)
                    found.append(h)
                    piece.append(np.full(len(h), i, np.int32))
                    place.append(np.arange(len(h), dtype=np.int32))
            hashes = np.concatenate(found)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            # A bit for the leading bits of each hash: most windows of a text end here.
            sieve = np.zeros(1 << _SIEVE_BITS, bool)
            sieve[hashes >> _U(64 - _SIEVE_BITS)] = True
            self.by_size[size] = hashes, np.concatenate(piece)[order], np.concatenate(place)[order], sieve
        self._known: dict[tuple[int, int], dict[bytes, list[str]]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def _behind(self, size: int, hash_: int) -> dict[bytes, list[str]]:
        """The word sequences with this hash and the items of each."""
        known = self._known.get((size, hash_))
        if known is None:
            hashes, piece, place, _ = self.by_size[size]
            known = {}
            for at in range(int(np.searchsorted(hashes, _U(hash_))), int(np.searchsorted(hashes, _U(hash_), side="right"))):
                words = b" ".join(self.bodies[piece[at]].split(b" ")[place[at] : place[at] + size])
                items = known.setdefault(words, [])
                if self.items[piece[at]] not in items:
                    items.append(self.items[piece[at]])
            self._known[size, hash_] = known
        return known

    def hits(self, data: bytes, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of every window of the texts that is a window of an item, word by word."""
        hashes = word_hashes(data, starts, ends)
        for size, (known, _, _, sieve) in self.by_size.items():
            windows = window_hashes(hashes, size)
            maybe = np.flatnonzero(sieve[windows >> _U(64 - _SIEVE_BITS)])
            maybe = maybe[text[maybe] == text[maybe + size - 1]]
            spot = np.minimum(np.searchsorted(known, windows[maybe]), len(known) - 1)
            for i in maybe[known[spot] == windows[maybe]]:
                items = self._behind(size, int(windows[i])).get(b" ".join(data[starts[i] : ends[i + size - 1]].split()))
                if items:
                    yield int(i), size, items


def benchmark_pieces(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, size, windows, body): the items' words, in pieces of at most ``PIECE`` windows that overlap by one word less than a window.

    An item of fewer words than a window is one window of that size; items without words go.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = normalised(text).split()
                size = min(window, len(words))
                for at in range(0, len(words) - size + 1, PIECE) if size else ():
                    part = words[at : at + PIECE + size - 1]
                    out.append((item, size, len(part) - size + 1, b" ".join(part)))
            yield pd.DataFrame(out, columns=["item", "size", "windows", "body"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), whole(text_col).alias("text"))
    return rows.mapInPandas(run, "item STRING, size INT, windows LONG, body BINARY")


FOUND = "spans ARRAY<STRUCT<first: LONG, n: LONG>>, items ARRAY<STRING>, n_words LONG"


def _scanner(spark: SparkSession, windows: Windows):
    """A column function (text, what earlier sets found or null) that adds the hits of one set of windows."""
    sent = spark.sparkContext.broadcast(windows)

    @F.pandas_udf(f"STRUCT<{FOUND}>")
    def scan(column: pd.Series, earlier: pd.DataFrame) -> pd.DataFrame:
        known, texts = sent.value, column.tolist()
        n_words = [0] * len(texts)
        spans = [[] if s is None else [(x["first"], x["n"]) for x in s] for s in earlier["spans"]]
        items = [set() if i is None else set(i) for i in earlier["items"]]
        for low, high in chunks(texts):
            raw = [normalised(t) for t in texts[low:high]]
            data = b" ".join(raw) + b" "
            starts, ends = word_spans(data)
            text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
            per = np.bincount(text, minlength=len(raw))
            before = np.concatenate(([0], np.cumsum(per)))
            n_words[low:high] = per.tolist()
            new: dict[int, list[tuple[int, int]]] = {}
            for first, size, which in known.hits(data, starts, ends, text):
                i = int(text[first])
                new.setdefault(i, []).append((first - int(before[i]), size))
                items[low + i].update(which)
            for i, found in new.items():
                spans[low + i] = merged([*spans[low + i], *found], int(per[i]))
        return pd.DataFrame({"spans": [[{"first": a, "n": n} for a, n in s] for s in spans], "items": [sorted(i) for i in items], "n_words": n_words})

    return scan


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """(_row, _found): each document's whole row, and the stretches of its words inside benchmark windows, the items, the number of words.

    The benchmark is counted before anything is sent: up to ``max_windows`` windows travel as one broadcast; more are dealt into as
    many sets, met one after the other with the results written in between, so a broadcast has a bound at every size. A window
    found by hash counts after its words are compared. Null texts have no words; a null item id reads ``null``; rows
    of one item id are one item; repeated documents are judged each; an empty benchmark finds nothing.
    """
    pieces = materialise(benchmark_pieces(benchmark, item_col, item_text_col, window))
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    rows = boxed(docs, _found=F.lit(None).cast(f"struct<{FOUND}>"))
    text = whole(F.col(f"_row.`{text_col}`"))
    if total <= max_windows:
        blocks = [pieces]
    else:
        order = [F.col("item"), F.col("size"), F.col("body")]
        dealt = running(pieces, [], order, "windows").withColumn("block", F.floor((F.col("upto") - F.col("windows")) / F.lit(max_windows)).cast("int"))
        dealt = materialise(dealt)
        blocks = [dealt.filter(F.col("block") == block) for block in range(-(-total // max_windows))]
    for i, block in enumerate(blocks):
        scan = _scanner(docs.sparkSession, Windows([tuple(p) for p in block.select("item", "size", "windows", "body").collect()]))
        rows = rows.select("_row", scan(text, "_found").alias("_found"))
        if i < len(blocks) - 1:
            rows = materialise(rows)
    return rows


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated) of ``contaminated_spans``; items are sorted."""
    hit = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda total, s: total + s["n"])
    return found.select(
        F.col(f"_row.`{id_col}`").alias("doc_id"), "_found.n_words", hit.alias("n_hit"), "_found.items", "_found.spans", (F.size("_found.spans") > 0).alias("contaminated"),
    )


def without_documents(found: DataFrame) -> DataFrame:
    """The documents that no benchmark window occurs in, columns as they came."""
    return found.filter(F.size("_found.spans") == 0).select("_row.*")


@F.pandas_udf(StringType())
def _cut(column: pd.Series, spans: pd.Series) -> pd.Series:
    texts = []
    for text, found in zip(column, spans, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        starts, ends = word_spans(normalised(text))
        kept, at = [], 0
        for s in found:
            kept.append(raw[at : starts[s["first"]]])
            at = ends[s["first"] + s["n"] - 1]
        texts.append(b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass"))
    return pd.Series(texts)


def without_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """All documents, less the text from the first to the last word of each stretch; other columns as they came, untouched texts too."""
    row = found.schema["_row"].dataType.names
    text = F.col(f"_row.`{text_col}`")
    cut = F.when(F.size("_found.spans") > 0, _cut(whole(text), "_found.spans")).otherwise(text)
    return found.select(*[(cut if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in row])

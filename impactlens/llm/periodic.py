"""Periodic stretches of words: direct lag scans for short periods, minimizers of many scales for the others."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from impactlens.llm.shared import chunks, whole
from impactlens.llm.words import mix64

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Periods up to here are found by comparing all words at that lag.
SHORT = 8
_U = np.uint64


def sliding(pick, x: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    have = 1
    out = x
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """(smallest, largest period) of each scale, from above ``SHORT`` up to ``longest``."""
    low = SHORT + 1
    while low <= longest:
        yield low, min(low * 3 // 2, longest)
        low = low * 3 // 2 + 1


class _Grams:
    """Hashes of any number of consecutive words, built from those of 1, 2, 4, ... words with a scramble at each step."""

    def __init__(self, words: np.ndarray):
        self.levels = [mix64(words.astype(_U) + _U(1))]

    def of(self, size: int) -> np.ndarray:
        """The hash of ``size`` words by the first of them."""
        level = size.bit_length() - 1
        while len(self.levels) <= level:
            have, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(mix64(have[:-step] * _U(0x9E3779B97F4A7C15) + have[step:]))
        part, rest = self.levels[level], size - (1 << level)
        return mix64(part[: len(part) - rest] * _U(0xC2B2AE3D27D4EB4F) + part[rest:]) if rest else part


def minimizer_pairs(grams: np.ndarray, low: int, high: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, distance) of neighbouring equal minimizers ``low`` to ``high`` words apart.

    A minimizer is a gram that is the least of some ``width`` neighbours.
    """
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding(np.minimum, grams, width)
    # The windows with place i are those that begin at i - width + 1 to i; beyond both ends there are none.
    edge = np.zeros(width - 1, _U)
    chosen = np.flatnonzero(sliding(np.maximum, np.concatenate((edge, least, edge)), width) == grams)
    chosen = chosen[np.argsort(grams[chosen], kind="stable")]
    apart = np.diff(chosen)
    fits = (grams[chosen[1:]] == grams[chosen[:-1]]) & (apart >= low) & (apart <= high)
    return chosen[:-1][fits], apart[fits]


def _agree(x: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from ``i`` on, forward or back, equal the word ``lag`` later."""
    done, size = 0, 64
    while True:
        if step > 0:
            a, b = x[i + done : i + done + size], x[i + lag + done : i + lag + done + size]
            a = a[: len(b)]
        else:
            low = max(0, i - done - size + 1)
            a, b = x[low : max(0, i - done + 1)][::-1], x[low + lag : max(0, i - done + 1) + lag][::-1]
        off = np.flatnonzero(a != b)
        if len(off):
            return done + int(off[0])
        done += len(a)
        if len(a) < size:
            return done
        size *= 2


def _has_smaller(x: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether a part of the period is a period of the stretch too; it holds several periods, so any smaller one divides it."""
    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            lag = period // p
            if np.array_equal(x[start : start + length - lag], x[start + lag : start + length]):
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def find_runs(x: np.ndarray, longest: int, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of word numbers, sorted.

    A run is a maximal stretch with its smallest period that has ``min_words`` words and ``min_periods`` (3 or more) periods at least.
    ``longest`` bounds the stretches; texts laid end to end are parted by numbers that occur once.

    Periods up to ``SHORT`` compare all words at that lag. Every other period q has a scale from ``low`` to ``high``. Its grams have
    ``high`` words, so inside a run equal grams stand whole periods apart, and its windows 2 * low - high + 1 grams, so
    two windows q apart fit into three periods. They hold the same words, so their minima are the same gram at distance q with no
    equal gram in between: the pair is a neighbouring one, and no run is missed. A pair is extended word by word in both directions.
    """
    if min_periods < 3:
        raise ValueError("runs of fewer than three periods are not covered by the windows")
    found: set[tuple[int, int, int]] = set()
    for q in range(1, min(SHORT, longest // min_periods) + 1):
        equal = np.concatenate(([False], x[:-q] == x[q:], [False]))
        edge = np.flatnonzero(equal[1:] != equal[:-1])
        start, size = edge[::2], edge[1::2] - edge[::2]
        for s, n in zip(start, size, strict=True) if size.max(initial=0) + q >= min_words else ():
            if n + q >= max(min_words, min_periods * q) and not _has_smaller(x, int(s), int(n) + q, q):
                found.add((int(s), int(n) + q, q))
    grams = _Grams(x)
    for low, high in scales(min(longest, len(x)) // min_periods):
        done: dict[int, int] = {}  # by period, where the last stretch ends
        places, apart = minimizer_pairs(grams.of(high), low, high, 2 * low - high + 1)
        for i in np.argsort(places, kind="stable"):
            at, q = int(places[i]), int(apart[i])
            if done.get(q, -1) > at:
                continue
            back = _agree(x, at - 1, q, -1) if at else 0
            start, end = at - back, at + _agree(x, at, q, 1) + q
            done[q] = end - q
            if end - start >= max(min_words, min_periods * q) and not _has_smaller(x, start, end - start, q):
                found.add((start, end - start, q))
    return sorted((s, n, q) for s, n, q in found)


def runs_of_texts(texts: list[list[bytes]], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words. All go into one sequence of exact word numbers, with a number of its own after each text."""
    number: dict[bytes, int] = {}
    starts, parts, at = [], [], 0
    for words in texts:
        starts.append(at)
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        parts.append(np.array([-1 - len(starts)], np.int64))
        at += len(words) + 1
    x = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, n, q in find_runs(x, max(map(len, texts), default=0), min_words, min_periods):
        i = int(np.searchsorted(starts, s, side="right")) - 1
        out[i].append((s - starts[i], n, q))
    return out


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words stand in a run after its first period."""
    gone = np.zeros(n, bool)
    for s, size, q in runs:
        gone[s + q : s + size] = True
    return gone


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, text): every periodic run of each whole text, and the text with each run cut to its first period.

    Words are runs of anything but space and U+0009 to U+000D. ``runs`` is sorted by start, then period; ``text`` has the kept
    words joined by one space, of texts without runs too. Texts are independent, so there is no shuffle; short texts are scanned
    together, a long one alone. Null texts are empty and give an empty text; repeated rows give equal rows; any id type is kept.
    """
    names = ["start", "length", "period"]

    @F.pandas_udf("STRUCT<n_words: LONG, runs: ARRAY<STRUCT<start: LONG, length: LONG, period: LONG>>, text: STRING>")
    def collapse(column: pd.Series) -> pd.DataFrame:
        rows = column.tolist()
        # Texts of about one length together, so that short ones meet few scales.
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        n_words, found, texts = [0] * len(rows), [[]] * len(rows), [""] * len(rows)
        for low, high in chunks([rows[i] for i in order]):
            split = [rows[i].encode("utf-8", "surrogatepass").split() for i in order[low:high]]
            for i, words, runs in zip(order[low:high], split, runs_of_texts(split, min_words, min_periods), strict=True):
                n_words[i], found[i] = len(words), [dict(zip(names, r, strict=True)) for r in runs]
                gone = dropped(runs, len(words)) if runs else None
                kept = words if gone is None else [w for w, g in zip(words, gone, strict=True) if not g]
                texts[i] = b" ".join(kept).decode("utf-8", "surrogatepass")
        return pd.DataFrame({"n_words": n_words, "runs": found, "text": texts})

    return docs.select(F.col(id_col).alias("doc_id"), collapse(whole(text_col)).alias("_c")).select("doc_id", "_c.*")


@F.pandas_udf(StringType())
def _rewritten(keys: pd.Series, column: pd.Series) -> pd.Series:
    texts = column.tolist()
    for i, doc in enumerate(keys):
        h = zlib.crc32(doc.encode()) if doc is not None else 1
        if h % 10 == 0 and (words := texts[i].encode("utf-8", "surrogatepass").split()):
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            texts[i] = b" ".join(words[:a] + [words[a + j % p] for j in range(n - a)]).decode("utf-8", "surrogatepass")
    return pd.Series(texts, dtype=object)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where one document in ten, by the crc32 of its id, repeats a stretch of its words up to its end.

    A null id has no crc32 and leaves its text as it is.
    """
    return docs.select(F.col(id_col).alias("doc_id"), _rewritten(F.col(id_col).cast("string"), whole(text_col)).alias("text"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The runs of ``collapse_runs`` as numbers and digests: the run of the greatest length by period, all runs, the collapsed text.

    Exponents are compared as fractions: with length = a * period + b, first a, then b / period by cross products.
    """
    best = F.aggregate(
        "runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
        lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top),
    )
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )

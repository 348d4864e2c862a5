"""Quality classifier: Bradley-Terry scores learned from preference pairs of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.llm.shared import boxed, chunks, unboxed, whole
from impactlens.llm.words import words
from impactlens.session import materialise

#: Labelled documents that training looks at, at most, half of each label; preference pairs drawn from them.
SAMPLE, PAIRS = 20_000, 100_000
#: The probability at which a document counts as good.
CUT = 0.3
_LETTER = np.zeros((4, 256), bool)
_LETTER[0, 65:91] = _LETTER[1, 97:123] = _LETTER[2, 128:256] = _LETTER[3, 48:58] = True
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CLASSES = np.concatenate([_LETTER, [_SPACE, ~(_LETTER.any(0) | _SPACE)]])
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_BASE = ["chars", "words", "lines", "word_chars", "words_per_line", "distinct_words", "top_word", "repeated_pairs", "short_words", "long_words", "upper_first"]
FEATURES = [*_BASE, "upper", "lower", "other_letters", "digits", "spaces", "signs", *[f"sign_{c}" for c in _SIGNS]]


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text, from the text alone; an empty text is all zeros."""
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    text = np.repeat(np.arange(n), sizes)
    table = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    one = np.maximum(sizes, 1)
    out = np.zeros((n, len(FEATURES)))
    of, hashes = words(texts)
    count = np.bincount(of, minlength=n).astype(float)
    lines = table[:, 10] + (sizes > 0)
    safe = np.maximum(count, 1)

    def repeats(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each group, and the count of its commonest."""
        order = np.lexsort((key, group))
        g, k = group[order], key[order]
        at = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1]))) if len(g) else np.zeros(0, bool))
        top = np.zeros(n)
        np.maximum.at(top, g[at], np.diff(np.append(at, len(g))))
        return np.bincount(g[at], minlength=n), top

    distinct, top = repeats(of, hashes)
    pair = np.flatnonzero(of[1:] == of[:-1])
    mixed = hashes[:-1][pair] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:][pair]
    pairs = np.bincount(of[pair], minlength=n)
    distinct_pairs, _ = repeats(of[pair], mixed)
    blank = _SPACE[data]
    edge = np.concatenate(([True], blank[:-1] | (text[1:] != text[:-1]))) & ~blank if len(data) else blank
    starts = np.flatnonzero(edge)
    ends = np.flatnonzero(np.concatenate((blank[1:] | (text[1:] != text[:-1]), [True])) & ~blank) if len(data) else starts
    runs = np.bincount(text[starts], minlength=n)
    lengths = ends - starts + 1
    share = lambda flag: np.bincount(text[starts], weights=flag, minlength=n) / np.maximum(runs, 1)
    letters = table[:, 65:91].sum(1) + table[:, 97:123].sum(1) + table[:, 128:].sum(1)
    base = [
        np.log1p(sizes), np.log1p(count), np.log1p(lines), letters / safe / 10, np.log1p(count / np.maximum(lines, 1)), distinct / safe, top / safe,
        1 - distinct_pairs / np.maximum(pairs, 1), share(lengths <= 2), share(lengths >= 12), share(_LETTER[0][data[starts]]) if len(data) else np.zeros(n),
    ]
    for i, column in enumerate(base):
        out[:, i] = column
    by_class = table @ _CLASSES.T / one[:, None]
    out[:, len(_BASE) : len(_BASE) + 6] = by_class
    out[:, len(_BASE) + 6 :] = np.sqrt(table[:, _SIGNS] / one[:, None])
    out[sizes == 0] = 0
    return out


def _by_chunk(texts: list[str], of) -> np.ndarray:
    return np.concatenate([of(texts[a:b]) for a, b in chunks(texts)])


def held_out(id_col: Column) -> Column:
    """The fifth of ids that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@dataclass(frozen=True)
class Ranker:
    """Score of a text: weights on standardised features."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def raw(self, texts: list[str]) -> np.ndarray:
        return _by_chunk(texts, lambda t: ((features(t) - self.center) / self.scale).clip(-8, 8) @ self.weights) if texts else np.zeros(0)


def bradley_terry(better: np.ndarray, worse: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights that maximise the likelihood that ``better[i]`` wins over ``worse[i]``: logistic loss on the feature differences, by Newton's method."""
    x = better - worse
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - 1) / len(x) + penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, pairs: int = PAIRS, seed: int = 5) -> Ranker | None:
    """Learns from about ``sample`` labelled texts outside the held-out fifth; None where a label is missing altogether.

    What is counted and drawn are distinct (label, id, text), so neither an id with many texts nor a repeated row can exceed the sample. Of
    each label an even share is drawn by hash: the sample is the same on every run, and its size ``sample`` up to the chance of that draw.
    """
    usable = labels.select(F.col(id_col).cast("string").alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(
        F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))
    )
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), whole(text_col).alias("text")).withColumn("_digest", F.xxhash64("text"))
    usable = materialise(rows.select("_id", "_digest").join(usable.distinct(), "_id").distinct())
    count = {r[0]: r[1] for r in usable.groupBy("_label").agg(F.count(F.lit(1))).collect()}
    if len(count) < 2:
        return None
    share = F.when(F.col("_label") == 1, sample / 2 / count[1]).otherwise(sample / 2 / count[0])
    chosen = materialise(usable.filter(F.pmod(F.xxhash64("_id", "_digest"), F.lit(1 << 20)) < share * (1 << 20)))
    # About ``sample`` keys, whatever the size of the corpus; of equal rows one is described.
    texts = rows.join(F.broadcast(chosen), ["_id", "_digest"]).select("_label", "_id", "_digest", "text").dropDuplicates(["_label", "_id", "_digest"])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _by_chunk(batch["text"].tolist(), features).astype(np.float32)
            yield batch[["_label", "_id", "_digest"]].assign(x=[f.tobytes() for f in found])

    got = texts.mapInPandas(describe, "_label INT, _id STRING, _digest LONG, x BINARY").toPandas()
    if got["_label"].nunique() < 2:
        return None
    got = got.sort_values(["_id", "_digest", "_label"], kind="stable")
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(float)
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x, y = ((x - center) / scale).clip(-8, 8), got["_label"].to_numpy()
    draw = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    return Ranker(center, scale, bradley_terry(x[draw.choice(good, pairs)], x[draw.choice(bad, pairs)]))


def scored(docs: DataFrame, ranker: Ranker | None, text_col: str, name: str = "_raw") -> DataFrame:
    if ranker is None:
        return docs.withColumn(name, F.lit(0.0))

    @F.pandas_udf("double")
    def raw(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.raw(texts.tolist()))

    return docs.withColumn(name, raw(whole(text_col)))


def cut_score(scores: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> float:
    """The quantile of the training labels' scores that leaves as many below it as have label 0; all of them count, not a sample."""
    usable = labels.select(F.col(id_col).cast("string").alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    known = materialise(usable.join(scores.select(F.col(id_col).cast("string").alias("_id"), "_raw"), "_id").select("_label", "_raw"))
    bad, n = known.agg(F.avg(1 - F.col("_label")), F.count(F.lit(1))).first()
    if not n:
        return 0.0
    low, high = known.agg(F.percentile_approx("_raw", [max(0.0, bad - 1 / n), min(1.0, bad + 1 / n)], 100_000)).first()[0]
    return (low + high) / 2


def probability(raw: Column, cut: float) -> Column:
    """The score as a probability whose value at the cut is CUT."""
    return 1 / (1 + F.exp(F.lit(cut - float(np.log(CUT / (1 - CUT)))) - raw))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``predicted`` is 1 from a score of CUT on.

    Null texts are empty, and an empty text is scored as such. Labels that are null, neither 0 nor 1, or without an id teach nothing;
    of conflicting labels each does. Without both labels every score is CUT. Repeated rows score alike.
    """
    ranker = train(docs, labels, id_col, text_col, label_col, **options)
    raw = materialise(scored(docs.select(F.col(id_col), F.col(text_col)), ranker, text_col).select(F.col(id_col), "_raw"))
    cut = cut_score(raw, labels, id_col, label_col) if ranker else 0.0
    score = probability(F.col("_raw"), cut) if ranker else F.lit(CUT)
    return raw.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """The documents that the classifier does not reject; columns as they came. Texts are scored where they are, so none is shuffled."""
    ranker = train(docs, labels, id_col, text_col, label_col, **options)
    if ranker is None:
        return docs
    raw = materialise(scored(docs.select(F.col(id_col), F.col(text_col)), ranker, text_col).select(F.col(id_col), "_raw"))
    cut = cut_score(raw, labels, id_col, label_col)
    rows = scored(boxed(docs, _text=F.col(text_col)), ranker, "_text")
    return unboxed(rows.filter(probability(F.col("_raw"), cut) >= CUT))

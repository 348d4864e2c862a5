"""Spelling variants: words one edit apart, found among the sorted rotations of all words."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.llm.shared import running, whole
from impactlens.session import materialise

MIN_LETTERS, MIN_COUNT = 5, 3
#: One run in so many loses a letter, where slips are planted.
SLIP_EVERY = 97
#: Ends a word; not a letter.
END = "$"
#: Longer keys are replaced by their first letters and a hash.
LONG_KEY, HEAD = 256, 32
#: Distinct words, and their bytes, that one task holds before it sends its counts on.
HELD_WORDS, HELD_BYTES = 200_000, 1 << 24
ROWS_OUT = 50_000
_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 % ((1 << 127) - 1)
# One byte per code point up to 255: A-Z become a-z, all that is no letter becomes a space.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _runs(text: str) -> list[bytes]:
    """The runs of letters, lower-cased, one byte a letter; code points beyond 255 are no letters."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _slipped(run: bytes, start: int, every: int) -> bytes:
    """The run, less one letter if its hash together with the document's says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, slip_every: int | None = None
) -> DataFrame:
    """(word, n): words of at least ``min_letters`` letters that occur at least ``min_count`` times over all texts.

    A word is a maximal run of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. With ``slip_every``, runs whose
    hash with the document's id is divisible by it lose one letter first. Tasks count before the shuffle. Null texts are empty, a
    null id reads as the empty id, repeated rows count each.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        held = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("latin-1") for w in counts], "n": list(counts.values())})

        for batch in batches:
            for doc, text in zip(batch["_id"], batch["text"], strict=True):
                found = Counter(_runs(text))
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in found.items():
                    if slip_every:
                        word = _slipped(word, start, slip_every)
                    if len(word) >= min_letters:
                        if word not in counts:
                            held += len(word)
                        counts[word] += n
                if len(counts) > HELD_WORDS or held > HELD_BYTES:
                    yield flush()
                    counts.clear()
                    held = 0
        if counts:
            yield flush()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), whole(text_col).alias("text"))
    counted = rows.mapInPandas(run, "word STRING, n LONG")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _long_keys(word: str) -> Iterator[tuple[str, bool, bool]]:
    """As ``rotation_keys``, with a rolling hash in place of a long key: linear in the word's length."""
    n = len(word)
    prefix, power = [0] * (n + 1), [1] * (n + 2)
    for i, c in enumerate(word):
        prefix[i + 1] = (prefix[i] * _BASE + ord(c)) % _PRIME
    for i in range(n + 1):
        power[i + 1] = power[i] * _BASE % _PRIME

    def key(start: int, stop: int) -> str:
        """word[start:], the end mark, word[:stop]."""
        size = n - start + 1 + stop
        head = word[start : start + HEAD] + (END + word[: min(stop, HEAD)] if n - start < HEAD else "")
        if size <= LONG_KEY:
            return word[start:] + END + word[:stop]
        tail = (prefix[n] - prefix[start] * power[n - start]) % _PRIME
        return f"{head[:HEAD]}~{size}~{(tail * power[stop + 1] + ord(END) * power[stop] + prefix[stop]) % _PRIME:x}"

    for i in range(n):
        yield key(i + 1, i), True, not i or word[i - 1] != word[i]
    for i in range(n + 1):
        yield key(i, i), False, False


def rotation_keys(word: str) -> Iterator[tuple[str, bool, bool]]:
    """(key, skips, first of its kind) of all rotations of ``word`` and its end mark.

    A rotation that ends with letter i has the rest as its prefix: words that share this prefix and are as long differ in that letter
    alone, and a word whose whole rotation is that prefix lacks the letter. Only the first of equal letters in a row counts as the
    one that is lacking, so that each pair meets once.
    """
    n = len(word)
    if n >= LONG_KEY:
        yield from _long_keys(word)
        return
    for i in range(n):
        yield word[i + 1 :] + END + word[:i], True, not i or word[i - 1] != word[i]
    for i in range(n + 1):
        yield word[i:] + END + word[:i], False, False


def _rotated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["key", "skips", "leads", "n", "id"]
    for batch in batches:
        out: list[tuple] = []
        for word, n, number in zip(batch["word"], batch["n"], batch["id"], strict=True):
            for key, skips, leads in rotation_keys(word):
                out.append((key, skips, leads, n, number))
                if len(out) >= ROWS_OUT:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)


def _neighbours(skips: np.ndarray, leads: np.ndarray, n: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
    """For each row of whole groups, how many near words its group holds and the best of them.

    A group's rows stand with the whole rotation first (one at most), then those that skip a letter, best first.
    """
    rows = len(n)
    end = np.append(begin[1:], rows)
    group = np.repeat(np.arange(len(begin)), end - begin)
    first = begin + ~skips[begin]  # the best row that skips a letter; may be the group's end
    size = end - first
    place = np.arange(rows)
    count = np.zeros(rows, np.int64)
    best = np.full(rows, -1, np.int64)
    others = skips & (size[group] > 1)
    count[others] = size[group][others] - 1
    best[others] = np.where(place == first[group], first[group] + 1, first[group])[others]

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a comes before row b as a form; -1 is no row."""
        return (b < 0) | (n[a] > n[b]) | ((n[a] == n[b]) & (ids[a] < ids[b]))

    # Those that have one letter more than the whole rotation's word, and that word.
    more = np.flatnonzero(skips & leads & ~skips[begin][group])
    short = begin[group[more]]
    count[more] += 1
    best[more] = np.where(better(short, best[more]), short, best[more])
    lead, at, times = np.unique(short, return_index=True, return_counts=True)
    count[lead] += times
    best[lead] = more[at]
    some = count > 0
    return pa.record_batch([pa.array(ids[some]), pa.array(count[some]), pa.array(n[best[some]]), pa.array(ids[best[some]])], ["id", "near", "best_n", "best"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the sorted keys; the last group waits for the next batch, as it may go on there."""
    held: pa.Table | None = None

    def done(table: pa.Table) -> pa.RecordBatch | None:
        keys = table.column("key").combine_chunks()
        new = np.concatenate(([True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)))
        begin = np.flatnonzero(new)
        shared = np.diff(np.append(begin, len(new))) > 1
        keep = np.repeat(shared, np.diff(np.append(begin, len(new))))
        if not keep.any():
            return None
        columns = [table.column(c).to_numpy()[keep] for c in ("skips", "leads", "n", "id")]
        return _neighbours(*columns, np.flatnonzero(new[keep]))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = table.column("key").combine_chunks()
        same = pc.equal(keys, keys[-1]).to_numpy(zero_copy_only=False)
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = table.slice(last)
        if last and (out := done(table.slice(0, last))) is not None:
            yield out
    if held is not None and (out := done(held)) is not None:
        yield out


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best) for the words of (id, word, n) that have a near word: one letter more, less or other.

    All rotations are range-partitioned and sorted, so a group of one prefix stands together; it has at most one row for each
    letter of the alphabet, whatever the corpus holds. Each row sends on one line with its group's count and best word; no pairs
    are made. Words of ``LONG_KEY`` letters or more sort by 127-bit hashes of their rotations, which together would be as long as
    the square of the word. ``best`` is the near word of the largest n, and of these the smallest id.
    """
    keys = words.select("id", "word", "n").mapInPandas(_rotated, "key STRING, skips BOOLEAN, leads BOOLEAN, n LONG, id LONG")
    ordered = keys.repartitionByRange("key").sortWithinPartitions("key", "skips", F.desc("n"), "id")
    found = ordered.mapInArrow(_scan, "id LONG, near LONG, best_n LONG, best LONG")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("id")))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("b")).select("id", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.id").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) by pointer jumping over (id, form): each round doubles the steps. A form is more frequent than its word, so no cycle."""
    state = materialise(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        jumped = materialise(state.join(ahead, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        state = jumped.select("id", "root")
        if jumped.filter("moved").isEmpty():
            return state


def variants(words: DataFrame, ratio: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all words of (word, n), which holds each word once.

    A word's form is its near word of the largest n (ties: the smallest in code-point order), if that is at least ``ratio`` times
    its own (over 1, so that chains end); the root is the end of the chain of forms. Words without near words have n_near 0 and
    are their own root; an empty table gives an empty result.
    """
    numbered = materialise(running(words.select("word", "n"), [], [F.col("word")]).withColumnRenamed("rn", "id"))
    near = materialise(near_words(numbered))
    forms = materialise(
        numbered.join(near, "id").filter(F.col("best_n") >= F.lit(ratio) * F.col("n")).select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    )
    chain = forms.join(roots(forms), "id")
    spelled = lambda name: numbered.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"))
    chain = chain.join(spelled("form"), "form").join(spelled("root"), "root").select("id", "form_word", "root_word", "form_n")
    out = numbered.join(near.select("id", "n_near"), "id", "left").join(chain, "id", "left")
    return out.select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )

"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactlens.llm.shared import whole
from impactlens.session import materialise

CAPACITY = 2048
END_ID = 0
#: The merge table's matcher keeps a stack entry for each character of a run of white space; longer runs go to the slower tokenizer.
LONGEST_BLANK = 10_000
_BLANK = re.compile(r"\s{%d}" % LONGEST_BLANK)
_encoders: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A byte-level BPE tokenizer file as a merge table: it gives the same ids in a fifth of the time.

    The ids of the vocabulary are the ranks of its merges; added tokens found in a text keep their ids. Texts with a run of
    white space beyond ``LONGEST_BLANK`` are encoded by the tokenizer itself.
    """
    if path not in _encoders:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # Byte-level BPE writes bytes that do not print as letters from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        coder = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        slower: list = []

        def encode(text: str) -> list[int]:
            if len(text) > LONGEST_BLANK and _BLANK.search(text):
                if not slower:
                    from tokenizers import Tokenizer

                    slower.append(Tokenizer.from_file(path))
                return slower[0].encode(text, add_special_tokens=False).ids
            return coder.encode(text, allowed_special="all") if any(a in text for a in added) else coder.encode_ordinary(text)

        _encoders[path] = encode
    return _encoders[path]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place): each text's ids and the end id, in pieces of at most ``capacity``.

    Only texts beyond the capacity are cut; their first piece takes what whole pieces leave. ``place`` numbers the pieces of one
    length inside a task's part.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            who, rows = [], []
            for i, text in enumerate(batch["text"]):
                ids = np.array([*encode(text), END_ID], np.dtype("<u4"))
                first = (len(ids) - 1) % capacity + 1
                start, piece = 0, 0
                while start < len(ids):
                    end = first if not piece else start + capacity
                    rows.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), part, int(seen[end - start])))
                    seen[end - start] += 1
                    who.append(i)
                    start, piece = end, piece + 1
            frame = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32", "part", "place"])
            yield pd.concat([batch[["_id"]].iloc[who].reset_index(drop=True), frame], axis=1)

    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("_id"), whole(text_col).alias("text"))
    cut = rows.mapInPandas(run, f"_id STRUCT<doc_id: {id_type}>, piece INT, start LONG, length LONG, ids_crc32 LONG, part INT, place LONG")
    return cut.select("_id.doc_id", *cut.columns[1:])


def fullest(lengths: list[int], counts: dict[int, int], space: int) -> list[int]:
    """The lengths, each at most as often as it is there, whose sum is the largest that ``space`` holds.

    ``reach`` is a bit set of the sums that can be made; a copy of it is kept for every copy of a length, by which the
    choice is traced back. Large lengths come first, so that among equal sums the small ones stay for later bins.
    """
    mask = (1 << (space + 1)) - 1
    reach, trail = 1, []
    for length in lengths:
        if length > space:
            continue
        for _ in range(min(counts[length], space // length)):
            grown = reach | (reach << length) & mask
            if grown == reach:
                break
            trail.append((length, reach))
            reach = grown
        if reach >> space & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(trail):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def bin_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, bins like it) for all pieces, by minimum bin slack over the counts of each length.

    Each bin starts with the longest piece left and takes the fullest combination of the others. The same bin is made as
    often as its pieces last, so every step uses up a length or nearly does, and the steps depend on the capacity and not on the
    number of pieces.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[list[int], int]] = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        chosen = [longest, *fullest([n for n in lengths if counts[n]], counts, capacity - longest)]
        counts[longest] += 1
        uses = {n: chosen.count(n) for n in set(chosen)}
        times = min(counts[n] // k for n, k in uses.items())
        out.append((sorted(chosen, reverse=True), times))
        for n, k in uses.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return out


def seats(patterns: list[tuple[list[int], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, the runs of its pieces in the order of their rank: first rank, first bin, seats per bin, offset of the first seat."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    bin_ = 0
    for lengths, times in patterns:
        offset = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            runs.setdefault(n, []).append((taken.get(n, 0), bin_, k, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += k * n
        bin_ += times
    return {n: dict(zip(("rank", "bin", "k", "offset"), np.array(r, np.int64).T, strict=True)) for n, r in runs.items()}


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Pieces of one length are alike to a packer, so the bins are planned over the counts of each length, which are at most
    ``capacity`` rows, and the pieces then take the planned seats by their rank among those of their length. Ranks are the place in
    the task that cut the piece, shifted by the parts before it, so a common length needs no task of its own. Null texts are
    empty and hold the end id alone; repeated rows are packed each.
    """
    pieces = materialise(token_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), capacity))
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = seats(bin_patterns(histogram, capacity))

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank, length = batch["rank"].to_numpy(), batch["length"].to_numpy()
            bins, offsets = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                runs = plan[int(n)]
                run = np.searchsorted(runs["rank"], rank[at], side="right") - 1
                inside = rank[at] - runs["rank"][run]
                bins[at] = runs["bin"][run] + inside // runs["k"][run]
                offsets[at] = runs["offset"][run] + inside % runs["k"][run] * n
            yield batch.drop(columns=["rank"]).assign(sequence_id=bins, offset=offsets)

    ranked = pieces.join(shifts, ["length", "part"]).select(
        F.struct("doc_id").alias("_id"), "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("shift")).alias("rank")
    )
    id_type = dict(docs.dtypes)[id_col]
    seated = ranked.mapInPandas(seat, f"_id STRUCT<doc_id: {id_type}>, piece INT, start LONG, length LONG, ids_crc32 LONG, sequence_id LONG, offset LONG")
    return seated.select("_id.doc_id", *seated.columns[1:])

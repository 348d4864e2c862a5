"""Line duplicate removal by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.llm.shared import whole
from impactlens.session import materialise

#: Lines under the rolling hash.
WINDOW = 2
#: Words in a window from which it always is a boundary; lighter ones are with a chance in proportion to their words.
HEAVY = 16
#: Lines without a boundary after which one is set.
LONGEST = 64
#: A single line of more words is a chunk as well.
LONG_LINE = 50
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def boundaries(lines: list[str]) -> list[int]:
    """Lines at which a window ends that is a boundary: its rolling hash over line hashes, modulo HEAVY, is below its words.

    The choice depends on nothing but the window, so inserted lines shift no boundary, and as weight makes boundaries, a passage of over
    50 words in two to four lines always has one, in more lines all but always. Without one in LONGEST lines the next is set by count.
    """
    hashes = [xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines]
    words = [len(line.split()) for line in lines]
    lead = pow(_BASE, WINDOW, 1 << 64)
    out, rolling, last = [], 0, -1
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h) & _MASK
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * lead) & _MASK
        if i >= WINDOW - 1 and ((rolling >> 32) % HEAVY < sum(words[i + 1 - WINDOW : i + 1]) or i - last >= LONGEST):
            out.append(i)
            last = i
    return out


def cut_lines(lines: list[str]) -> list[tuple[int, int]]:
    """Chunks as (first line, lines), in order: the window at every boundary; each of its extensions, line by line, up to and
    with the nearest line of the next boundary's window on either side; lines of over LONG_LINE words. A text of several lines without a boundary is one chunk.
    """
    out = {(i, 1) for i, line in enumerate(lines) if len(line.split()) > LONG_LINE}
    ends = boundaries(lines)
    if not ends and len(lines) > 1:
        out.add((0, len(lines)))
    for at, after in zip([-1, *ends], [*ends, len(lines) + WINDOW - 1]):
        top, bottom = at + 1 - WINDOW, after + 1 - WINDOW
        if at >= 0:
            out.add((top, WINDOW))
            out.update((top, line + 1 - top) for line in range(at + 1, min(bottom + 1, len(lines))))
        if after < len(lines):
            out.update((line, after + 1 - line) for line in range(max(at, 0), bottom))
    return sorted(out)


FIELDS = "doc_id LONG, _text LONG, start INT, n INT, key BINARY"


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Place and hash of every chunk; the hash is taken over the digests of its lines."""
    for batch in batches:
        docs, numbers, starts, sizes, keys = [], [], [], [], []
        for doc, number, text in zip(batch["doc_id"], batch["_text"], batch["text"], strict=True):
            lines = text.split("\n")
            digests = [xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for line in lines]
            for start, n in cut_lines(lines):
                docs.append(doc)
                numbers.append(number)
                starts.append(start)
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(b"".join(digests[start : start + n])))
            if len(keys) > 1 << 18:
                yield pd.DataFrame({"doc_id": docs, "_text": numbers, "start": starts, "n": sizes, "key": keys})
                docs, numbers, starts, sizes, keys = [], [], [], [], []
        if keys:
            yield pd.DataFrame({"doc_id": docs, "_text": numbers, "start": starts, "n": sizes, "key": keys})


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks of a text whose hash repeats, with their bytes."""
    names = ["doc_id", "_text", "start", "n", "key", "body"]
    for batch in batches:
        out, held = [], 0
        for doc, number, text, spans in zip(batch["doc_id"], batch["_text"], batch["text"], batch["spans"], strict=True):
            lines = text.split("\n")
            for s in spans:
                body = "\n".join(lines[s["start"] : s["start"] + s["n"]])
                out.append((doc, number, s["start"], s["n"], s["key"], body))
                held += len(body)
            if held > 1 << 22:
                yield pd.DataFrame(out, columns=names)
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)


def _drop_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, n_lines, cut = [], [], []
        for text, spans, undo in zip(batch["text"], batch["spans"], batch["undo"], strict=True):
            lines = text.split("\n")
            stay = {(s["start"], s["n"]) for s in undo} if undo is not None else ()
            later = [s for s in spans if s["later"] and (s["start"], s["n"]) not in stay] if spans is not None else []
            gone = {i for s in later for i in range(s["start"], s["start"] + s["n"])}
            n_lines.append(len(lines))
            cut.append(len(gone))
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
        yield batch[["_id"]].assign(text=texts, n_lines=n_lines, removed_lines=cut)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, removed_lines): texts without the passages of several lines that came before.

    Chunks (``cut_lines``) overlap: a boundary's window is the anchor of a repeated passage, its extensions carry the match line by
    line to the passage's ends. Of equal chunks the first in the order of (id, text, line) stays, null ids last. A line goes if
    a later chunk holds it, so its equal stands at an earlier place. Each text is shuffled once, to meet the places of its repeated
    chunks; their bytes are then compared, and a chunk that only shares a hash is put back. Null texts are empty and have one empty
    line. Rows with the same id and text are treated alike, so both keep what the first of them keeps. Ids must be whole numbers below 2^63 - 1.
    """
    last = F.lit(2**63 - 1)
    text = whole(text_col)
    # Null ids travel as the largest number: pandas has no null among whole numbers.
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), F.xxhash64(text).alias("_text"), text.alias("text"))
    found = materialise(rows.mapInPandas(_found, FIELDS))
    place = F.struct("doc_id", "_text", "start", "n")
    first = materialise(found.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "first"))
    repeated = found.join(first, "key").withColumn("later", place != F.col("first"))
    spans = repeated.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("start", "n", "key", "later")).alias("spans"))
    # Always merged, so that the plan does not change with the size of the spans.
    joined = materialise(rows.join(spans.hint("merge"), ["doc_id", "_text"], "left"))
    bodies = joined.filter(F.col("spans").isNotNull()).mapInPandas(_bodies, f"{FIELDS}, body STRING")
    # Grouping by the body itself compares the bytes; a common chunk meets as one row per task.
    groups = bodies.groupBy("key", "body").agg(F.min(place).alias("own")).select("key", "own")
    undo = groups.join(first, "key").filter("own <> first").groupBy("own.doc_id", "own._text").agg(F.collect_list(F.struct("own.start", "own.n")).alias("undo"))
    undo = materialise(undo.toDF("doc_id", "_text", "undo"))
    cut = joined.join(undo, ["doc_id", "_text"], "left").select(F.struct(F.nullif("doc_id", last).alias("doc_id")).alias("_id"), "text", "spans", "undo")
    done = cut.mapInPandas(_drop_lines, "_id STRUCT<doc_id: LONG>, text STRING, n_lines LONG, removed_lines LONG")
    return done.select("_id.doc_id", "text", "n_lines", "removed_lines")

"""WARC archives in Zstandard: writing with a shared dictionary, and reading back with validation."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlens.llm.shared import whole
from impactlens.session import materialise, scratch_dir

#: The skippable frame that holds a dictionary, and the profile of a revisit.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload after which a task begins another archive.
ARCHIVE_BYTES = 16 << 20
#: Pages that the dictionary is trained on, and the bytes of each, at most.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 16, 1 << 16


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary(pages: DataFrame, id_col: str, payload: Column) -> bytes:
    """A dictionary trained on pages drawn by the hash of their ids; empty when they are too few to train on."""
    share = SAMPLE_PAGES / max(1, pages.count())
    drawn = pages.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share * (1 << 30)).select(F.substring(payload, 1, SAMPLE_BYTES).alias("p")).limit(SAMPLE_PAGES).collect()
    samples = sorted(r.p.encode("utf-8", "surrogatepass") for r in drawn if r.p)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _line(text: str) -> str:
    """Text for a header line: control signs are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record: a response with the page, or a revisit with its HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 2025-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row as a WARC record into ``.warc.zst`` files under ``path``: (file, records), the files that count.

    Of equal payloads the row with the smallest id (null ids last) is a response, the others revisit it; repeated rows of that id are
    responses all. An archive begins with the dictionary in a skippable frame, then each record is a frame of its own. A task writes under a
    name of its own and only the files of the attempt that ended are listed, so a repeated task leaves nothing that is read.
    """
    import pyarrow.fs as fs

    payload = whole(html_col)
    shared = dictionary(pages, id_col, payload)
    keyed = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    keyed = keyed.withColumn("_key", F.sha2("html", 256))
    # Only keys that repeat; most pages join with nothing.
    known = keyed.groupBy("_key").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"))).alias("_m"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    known = materialise(known.select(F.col("_key").alias("_k"), F.col("_m._id").alias("_first")))
    joined = keyed.join(known, F.col("_key") == F.col("_k"), "left")
    repeat = F.col("_k").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    rows = joined.select("page", "url", "html", F.when(repeat, F.coalesce(F.col("_first").cast("string"), F.lit("null"))).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdCompressor(level=3)
        out, written, records, number, done = None, 0, 0, 0, []
        for batch in batches:
            for page, url, html, first in zip(batch["page"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    file = f"{name}-{number:04d}.warc.zst"
                    out, written, records = store.open_output_stream(f"{base}/{file}", compression=None), 0, 0
                    if shared:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(shared)) + shared)
                body = html.encode("utf-8", "surrogatepass")
                out.write(coder.compress(record(page if page is not None else "null", url, body, sha1_base32(body), first)))
                written, records = written + len(body), records + 1
                if written >= archive_bytes:
                    out.close()
                    done.append((file, records))
                    out, number = None, number + 1
        if out is not None:
            out.close()
            done.append((file, records))
        if done:
            yield pd.DataFrame(done, columns=["file", "records"])

    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    return materialise(rows.mapInPandas(write, "file STRING, records LONG"))


def frames(data: bytes) -> Iterator[bytes]:
    """The contents of the frames of an archive, one by one, with the dictionary of its leading skippable frame."""
    at, coder = 0, zstandard.ZstdDecompressor()
    view = memoryview(data)
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == DICTIONARY_MAGIC:
            held = bytes(view[8 : 8 + size])
            if len(held) != size:
                raise ValueError("the dictionary frame is cut")
            if held[:4] == b"\x28\xb5\x2f\xfd":
                held = zstandard.ZstdDecompressor().decompress(held)
            coder, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)), 8 + size
    while at < len(data):
        if 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one, out = coder.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut")
            piece = view[at : at + (1 << 15)]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


HEADER = re.compile(rb"^([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*(.*)$")


def parse(data: bytes) -> dict:
    """The fields of a record, with ``problem`` where its version, headers, lengths, end or digest are wrong, else None."""
    out = {"page": None, "record_type": None, "refers_to": None, "url": None, "payload_bytes": None, "payload_digest": None, "problem": None}

    def wrong(what: str) -> dict:
        return out | {"problem": what}

    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return wrong("version")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        if not (m := HEADER.match(line)):
            return wrong("header")
        fields[m[1].decode().lower()] = m[2].decode("utf-8", "surrogatepass")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        return wrong(f"missing {min(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return wrong("length")
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)\r?$", http)
    ids = [re.fullmatch(r"<urn:page:(.*)>", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to")]
    if not blank or not size or not ids[0]:
        return wrong("block")
    out |= {"page": ids[0][1], "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"), "payload_bytes": int(size[1]), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
    if fields["warc-type"] == "revisit":
        return out | {"refers_to": ids[1][1]} if ids[1] and not payload else wrong("revisit")
    if len(payload) != int(size[1]):
        return wrong("payload length")
    return out if sha1_base32(payload) == out["payload_digest"] else wrong("digest")


FIELDS = "page STRING, record_type STRING, refers_to STRING, url STRING, payload_bytes LONG, payload_digest STRING, problem STRING"


def read_archives(spark: SparkSession, path: str, files: DataFrame | None = None, with_payload: bool = False) -> DataFrame:
    """The records of the ``.warc.zst`` files under ``path`` (of those in ``files``), each validated; a wrong one is a row with its ``problem``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    if files is not None:
        found = found.withColumn("file", F.substring_index("path", "/", -1)).join(files.select("file"), "file", "left_semi")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows: list[dict] = []
                try:
                    for frame in frames(content):
                        rows.append(parse(frame) | ({"payload": frame.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2][:-4]} if with_payload else {}))
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows).astype({"payload_bytes": "Int64"})
                            rows = []
                except (ValueError, struct.error, zstandard.ZstdError) as e:
                    rows.append(parse(b"") | {"problem": f"frame: {e}"} | ({"payload": None} if with_payload else {}))
                if rows:
                    yield pd.DataFrame(rows).astype({"payload_bytes": "Int64"})

    return found.select("content").mapInPandas(read, FIELDS + (", payload BINARY" if with_payload else ""))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Writes the pages as archives and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url, problem)."""
    spark = pages.sparkSession
    named = spark._jvm.org.apache.hadoop.fs.Path(path or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}")
    full = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()
    where = re.sub("^file:/+", "file:///", full)
    files = write_archives(pages, where, id_col, url_col, html_col)
    back = read_archives(spark, where, files)
    kind = dict(pages.dtypes)[id_col]
    as_id = lambda c: F.expr(f"try_cast(nullif({c}, 'null') AS {kind})")
    return back.select(as_id("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"), "url", "problem")

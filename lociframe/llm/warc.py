"""WARC archives with a two-level capture index.

Every page becomes a record, a gzip member of its own, in an archive file per task; the rows that a task returns say
where its records lie, so files of failed attempts are never referred to. Of pages with equal payloads, the one with the
largest id is a response and the others are revisits of it: only digests are grouped, payloads are not shuffled.

The index sorts captures by key, the URL with its host reversed, and writes them as compressed blocks of BLOCK captures
into a file per range of keys. A sparse directory has one row per block: its first key and its place. A lookup finds the
range of a key, searches the directory of that range by halves, reads and inflates that block alone, searches it by
halves, and reads the record's own bytes out of the archive.

Files lie below spark.checkpoint.dir and are written and read through pyarrow.fs, so any store it knows will do. A null url is
the empty key, a null html the empty payload, a null page_id stays null and is the smallest. Rows repeated with one id and payload
are of the same kind, and all are kept. Payloads of fewer bytes than `least` are always responses. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.common import join_measured
from lociframe.session import checkpoint_dir, stored

BLOCK, RANGE, LEVEL = 512, 50_000, 4
DATE = "2000-01-01T00:00:00Z"
NULL = -(1 << 63)
CAPTURE = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def reversed_key(url: str | None) -> str:
    """`com,example,www)/path?query` of a URL, without scheme and fragment."""
    rest = (url or "").split("#", 1)[0].split("://", 1)[-1]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:] if rest else ""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, original: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit of the page `original`, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if original is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{original}>"]
    block = http if original is not None else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _headers(raw: bytes) -> tuple[dict[str, str], int]:
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}, end + 4


def _page(urn: str) -> int | None:
    name = urn[len("<urn:page:"):-1]
    return None if name == "None" else int(name)


def read_record(raw: bytes) -> dict:
    """A capture out of the bytes of its gzip member; a response is checked against its digest."""
    raw = zlib.decompress(raw, 31)
    head, at = _headers(raw)
    block = raw[at:at + int(head["content-length"])]
    http, at = _headers(block)
    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    payload = block[at:] if kind == "response" else None
    if payload is not None and digest_of(payload) != digest:
        raise ValueError(f"{head['warc-record-id']}: the payload is not that of its digest")
    return {"page_id": _page(head["warc-record-id"]), "payload_bytes": len(payload) if payload is not None else int(http["content-length"]), "payload_digest": digest,
            "record_type": kind, "refers_to": _page(head["warc-refers-to"]) if kind == "revisit" else None, "html": None if payload is None else payload.decode()}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _archiver(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "original"))):
                raw = write_record(page_id, url, html.encode(), None if original is None else original)
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(raw)
                rows.append((reversed_key(url), page_id, name, at, len(raw)))
                at += len(raw)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                                 names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()
    return run


def write_archives(pages: DataFrame, least: int = 0) -> tuple[str, DataFrame]:
    """The folder of the archives, and the stored places (key, page_id, file, offset, length) of their records."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.coalesce(F.col("page_id").cast("long"), F.lit(NULL).cast("long")).alias("_p"), F.sha1(F.encode(html, "utf-8")).alias("_sha"))
    digests = stored(keyed.select("_p", "_sha", F.octet_length("html").alias("bytes")))
    groups = digests.filter(F.col("bytes") >= least).groupBy("_sha").agg(F.max("_p").alias("original"), F.min("_p").alias("first")).filter("first < original").drop("first")
    revisits = stored(digests.join(groups, "_sha").filter(F.col("_p") < F.col("original")).select("_p", "_sha", "original").distinct())
    marked = join_measured(keyed, revisits, ["_p", "_sha"], "left", width=80).select("page_id", "url", "html", "original")
    return folder, stored(marked.mapInArrow(_archiver(folder), "key string, page_id long, file string, offset long, length long"))


def _indexer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name, out, at, held = f"{uuid.uuid4().hex}.index", None, 0, []

        def block(rows):
            nonlocal out, at
            if out is None:
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            raw = zlib.compress(json.dumps(rows, ensure_ascii=False).encode(), 6)
            out.write(raw)
            row = (rows[0][0], rows[-1][0], name, at, len(raw))
            at += len(raw)
            return row
        done = []
        for batch in batches:
            held += map(list, zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length"))))
            while len(held) >= BLOCK:
                done.append(block(held[:BLOCK]))
                held = held[BLOCK:]
        if held:
            done.append(block(held))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                             names=["first_key", "last_key", "file", "offset", "length"])
    return run


def build_index(folder: str, places: DataFrame) -> DataFrame:
    """The stored directory (first_key, last_key, file, offset, length), one row per compressed block of captures."""
    total = places.count()
    parts = max(1, -(-total // max(RANGE, total // 10_000)))     # at most 10,000 ranges
    ordered = places.repartitionByRange(parts, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return stored(ordered.mapInArrow(_indexer(folder), "first_key string, last_key string, file string, offset long, length long"))


def _reader(folder: str, payload: bool):
    def run(keys: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
        store, base = _store(folder)
        directory = directory.sort_values("offset", kind="stable")
        firsts, blocks = directory["first_key"].tolist(), directory[["file", "offset", "length"]].values.tolist()

        @lru_cache(64)
        def opened(name):
            return store.open_input_file(f"{base}/{name}")

        @lru_cache(4)
        def captures(i):
            name, at, size = blocks[i]
            return json.loads(zlib.decompress(opened(name).read_at(size, at)))
        out = []
        for key in sorted(keys["key"]):
            i = max(0, bisect_left(firsts, key) - 1)
            while i < len(firsts) and firsts[i] <= key:
                rows = captures(i)
                j = bisect_left(rows, key, key=lambda r: r[0])
                while j < len(rows) and rows[j][0] == key:
                    _, _, name, at, size = rows[j]
                    found = read_record(opened(name).read_at(size, at))
                    out.append((key, *(found[c] if c != "html" or payload else None for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"))))
                    j += 1
                i += 1
        result = pd.DataFrame(out, columns=[x.split()[0] for x in CAPTURE.split(", ")])
        return result.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
    return run


def lookup(folder: str, directory: DataFrame, urls: DataFrame, payload: bool = True) -> DataFrame:
    """Every capture of the URLs in urls (url): key, page_id, payload_bytes, payload_digest, record_type, refers_to, html of responses."""
    ranges = sorted((r["first"], r["last"], r["file"]) for r in
                    directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect())   # at most 10,000 rows
    firsts, lasts = [r[0] for r in ranges], [r[1] for r in ranges]

    @F.arrow_udf(T.StructType([T.StructField("key", T.StringType()), T.StructField("files", T.ArrayType(T.StringType()))]))
    def place(url: pa.Array) -> pa.Array:
        out = []
        for u in url.to_pylist():
            key = reversed_key(u)
            i, files = bisect_left(lasts, key), []
            while i < len(ranges) and firsts[i] <= key:
                files.append(ranges[i][2])
                i += 1
            out.append({"key": key, "files": files})
        return pa.array(out, pa.struct([("key", pa.string()), ("files", pa.list_(pa.string()))]))
    placed = urls.select(place(F.col("url")).alias("at")).select(F.col("at.key").alias("key"), F.explode("at.files").alias("file")).distinct()
    return placed.groupBy("file").cogroup(directory.groupBy("file")).applyInPandas(_reader(folder, payload), CAPTURE)

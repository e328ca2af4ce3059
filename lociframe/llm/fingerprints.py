"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a piece where it is one less than a multiple of the block size;
so piece borders depend on the text around them and move with it. A piece's hash gives one letter of the signature. A
fingerprint is `block:signature:signature at twice the block`. The block size follows the length of the text, and
is doubled or halved while the text gives too many or too few pieces, so signatures have at most MOST letters.

Two fingerprints are compared at a block size that both have, by the edit distance of the signatures there (insertions
and deletions, so their longest common subsequence), as a share of their length; without a common run of
GATE letters, or of half the shorter one, they count as unlike.

Null and empty texts have the fingerprint `3::`, which is like itself. Equal texts have equal fingerprints. The
next document is that of the next larger id, then text hash; a null id is the least; a repeated row is its own
next. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.common import with_key

SMALLEST, WINDOW, FEWEST, MOST, GATE = 3, 7, 24, 96, 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(LETTERS.encode(), np.uint8)
_POWERS = np.ones(1, np.uint32)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(2 * n, 0x01000193, np.uint32)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base, dtype=np.uint32)
    return _POWERS


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at every place."""
    wide = (data + np.uint32(1)) * np.uint32(0x9E3779B1)
    out = wide.copy()
    for k in range(1, min(WINDOW, len(data))):
        out[k:] += wide[:-k] * np.uint32(pow(0x85EBCA6B, k, 1 << 32))
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def _signature(data: np.ndarray, ends: np.ndarray) -> str:
    """One letter per piece; ends are the last bytes of all pieces but a rest."""
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < len(data)]
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    sums = np.add.reduceat((data + np.uint32(1)) * _powers(int(lengths.max()))[place], starts, dtype=np.uint32)
    sums ^= sums >> np.uint32(16)
    sums *= np.uint32(0x7FEB352D)
    return _LETTERS[(sums >> np.uint32(26)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return f"{SMALLEST}::"
    data = raw.astype(np.uint32)
    rolled = _rolling(data)

    def ends(block: int) -> np.ndarray:
        return np.flatnonzero(rolled % np.uint32(block) == block - 1)
    block = SMALLEST
    while block * 64 < len(raw):
        block *= 2
    found = ends(block)
    while len(found) >= MOST and block < 1 << 30:
        block *= 2
        found = found[rolled[found] % np.uint32(block) == block - 1]
    while len(found) < FEWEST and block > SMALLEST:
        more = ends(block // 2)
        if len(more) >= MOST:
            break
        block, found = block // 2, more
    twice = found[rolled[found] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(data, found)}:{_signature(data, twice)}"


def _alike(a: str, b: str) -> float:
    """1 less the edit distance as a share of both lengths; 0 without a common run of letters."""
    if a == b:
        return 1.0
    gate = min(GATE, (min(len(a), len(b)) + 1) // 2)
    runs = {a[i:i + gate] for i in range(len(a) - gate + 1)}
    if not gate or not any(b[i:i + gate] in runs for i in range(len(b) - gate + 1)):
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full                                  # a zero bit where the common subsequence grows
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1 for two fingerprints."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    if m == n:
        return max(_alike(a1, b1), _alike(a2, b2) if min(len(a2), len(b2)) > GATE else 0.0)
    if int(m) == 2 * int(n):
        return _alike(a1, b2)
    if int(n) == 2 * int(m):
        return _alike(a2, b1)
    return 0.0


def neighbours(docs: DataFrame, rows: int = 5000) -> DataFrame:
    """docs (doc_id, text) dealt into ranges of ids, sorted, with bucket and tail.

    A range ends with a copy (tail) of the first document of the next one, the last range with that of the
    first: a row's next document is then the following row. Ranges are cut at quantiles of the ids, of about `rows`
    documents or more, so that at most 20,000 borders come to the driver.
    """
    docs = with_key(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    total = docs.count()
    n = max(1, min(-(-total // rows), 20_000))
    borders = sorted({int(x) for x in docs.approxQuantile("_d", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []

    @F.arrow_udf(T.IntegerType())
    def bucket_of(d: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(borders, np.int64), d.to_numpy(zero_copy_only=False), side="right").astype(np.int32))
    dealt = docs.withColumn("bucket", bucket_of("_d"))
    firsts = sorted((r["bucket"], r["first"]) for r in dealt.groupBy("bucket").agg(F.min(F.struct("_d", "_h")).alias("first")).collect())
    heads = [(f["_d"], f["_h"], firsts[i - 1][0]) for i, (_, f) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(heads, "_d long, _h long, other int")
    both = dealt.join(F.broadcast(heads), ["_d", "_h"], "left")          # at most 20,000 rows
    own = F.struct("bucket", F.lit(False).alias("tail"))
    more = F.struct(F.col("other").alias("bucket"), F.lit(True).alias("tail"))
    at = F.explode(F.when(F.col("other").isNull(), F.array(own)).otherwise(F.array(own, more)))
    out = both.select("doc_id", "_d", "_h", "text", at.alias("at")).select("doc_id", "_d", "_h", "text", "at.bucket", "at.tail")
    return out.repartition(len(borders) + 1, "bucket").sortWithinPartitions("bucket", "tail", "_d", "_h").select("doc_id", "text", "bucket", "tail")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    prior, out = None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    for batch in batches:
        for doc_id, text, bucket, tail in zip(*(batch.column(i).to_pylist() for i in range(4))):
            print_ = fingerprint(text)
            if prior is not None and prior[2] == bucket:
                own, mine, _, own_print = prior
                half = len(mine) // 2
                edited = mine[:len(mine) - half] + text[:half]
                edited_print = fingerprint(edited)
                out.append((own, len(mine), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_print, edited_print,
                            likeness(own_print, edited_print), likeness(own_print, print_)))
                if len(out) == 1000:
                    yield flush()
                    out = []
            prior = None if tail else (doc_id, text, bucket, print_)
    if out:
        yield flush()


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its text with the last half replaced from the next document, and likenesses."""
    return neighbours(docs).mapInArrow(_pairs, SCHEMA)

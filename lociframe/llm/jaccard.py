"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of hashed runs of five words. Equal sets form a class, and classes are joined: a MinHash
signature is cut into bands, and texts that agree in a band are candidates. A pair's MinHash values are
then compared some at a time; as soon as the posterior probability that its Jaccard similarity reaches
the threshold (uniform prior, so a Beta posterior) falls below a tolerance, the pair is dropped. What
remains is verified exactly on the sets.

Nothing quadratic leaves a task. The bands' buckets give connected components of candidates; each class's set is
sent once to its component, where pairs are formed, pruned and verified in arrays, and only counts of links
and one edge per class come back. A component above CHUNK_ROWS classes or CHUNK_BYTES is cut into chunks, and each
pair of chunks is a task, so no task grows with a group. Twenty bands of four miss a pair of similarity 0.8 with
probability 3e-5.

Texts are lower-cased and cut at white space; one of fewer than five words is a single run. Null and
empty texts have no runs: they are copies of one another and linked to nothing else. A row repeated with the same
id and text is a copy like any other. A null id stays null, and class ids are the least ids that are not null.
Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import components, join_measured, with_key
from lociframe.llm.words import mix, released, shingle_sets, slices
from lociframe.session import stored

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS, HASHES, STEP, TOLERANCE = 20, 4, 96, 16, 1e-5
CHUNK_ROWS, CHUNK_BYTES = 1024, 8 << 20
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per set (none empty)."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= 1 << 15):
            total += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:end]])[:-1]])
        for k in range(HASHES):
            out[at:end, k] = np.minimum.reduceat(((flat * _FACTORS[k]) >> np.uint64(32)).astype(np.uint32), starts)
        at = end
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A hash per band, one row per signature."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix(out + sig[:, r:BANDS * ROWS:ROWS].astype(np.uint64) + np.uint64(1))
    return mix(out ^ (np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32)))


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values, the fewest matches with which P(similarity >= threshold) is at least the tolerance."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def _pairs_of_runs(order: np.ndarray, values: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x < y) of items with equal values, in blocks of about `limit`."""
    sorted_ = values[order]
    cuts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]]))
    end = np.repeat(cuts[1:], np.diff(cuts))
    later = end - np.arange(len(order)) - 1           # partners of each item further on in its run
    done = np.concatenate([[0], np.cumsum(later)])
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(done, done[a] + limit, side="right")) - 1)
        left = np.repeat(np.arange(a, b), later[a:b])
        right = left + 1 + np.arange(len(left)) - np.repeat(done[a:b] - done[a], later[a:b])
        if len(left):
            x, y = order[left].astype(np.int32), order[right].astype(np.int32)
            yield np.minimum(x, y), np.maximum(x, y)
        a = b


def similar_pairs(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of items whose sets have a Jaccard similarity of the threshold; with sides, only pairs across them."""
    bands, least = band_hashes(sig), least_matches(threshold, tolerance)
    xs, ys = [], []
    for band in range(BANDS):
        for x, y in _pairs_of_runs(np.argsort(bands[:, band], kind="stable"), bands[:, band]):
            keep = np.ones(len(x), bool) if side is None else side[x] != side[y]
            for earlier in range(band):           # each pair belongs to the first band that it shares
                keep &= bands[x, earlier] != bands[y, earlier]
            x, y = x[keep], y[keep]
            matches = np.zeros(len(x), np.int32)
            for n, m in least.items():
                if not len(x):
                    break
                matches += (sig[x, n - STEP:n] == sig[y, n - STEP:n]).sum(axis=1, dtype=np.int32)
                keep = matches >= m
                x, y, matches = x[keep], y[keep], matches[keep]
            xs.append(x)
            ys.append(y)
    x, y = np.concatenate(xs) if xs else np.zeros(0, int), np.concatenate(ys) if ys else np.zeros(0, int)
    if not len(x):
        return x, y
    sizes = np.array([len(s) for s in sets])
    shared = _shared(sets, x, y)
    keep = shared >= threshold * (sizes[x] + sizes[y] - shared) - 1e-9
    return x[keep], y[keep]


def _shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, columns: int = 2048) -> np.ndarray:
    """How many values the sets of each pair share."""
    if len(x) <= 8 * len(sets):
        out = np.empty(len(x), np.int64)
        for i, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
            a, b = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
            out[i] = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
        return out
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = times > 1
    column = np.cumsum(often)[code] - 1
    row, column = row[often[code]], column[often[code]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    product = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(often.sum()), columns):
        a, b = np.searchsorted(column, [first, first + columns])
        dense = np.zeros((len(sets), columns), np.float32)
        dense[row[a:b], column[a:b] - first] = 1
        product += dense @ dense.T
    return product[x, y].astype(np.int64)


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least item of each item's group under the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(batch.column("text"), SIZE)
        full = [i for i, s in enumerate(sets) if len(s)]
        sig = signatures([sets[i] for i in full]) if full else np.zeros((0, HASHES), np.uint32)
        sigs: list[bytes | None] = [None] * len(sets)
        for row, i in zip(sig, full):
            sigs[i] = row.tobytes()
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_d"), batch.column("_h"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array([8 * len(s) for s in sets], pa.int64())],
            names=["doc_id", "_d", "_h", "key", "sig", "bytes"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("sig").to_pylist()
        if raw:
            hashes = band_hashes(np.frombuffer(b"".join(raw), np.uint32).reshape(-1, HASHES))
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(raw)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.reshape(-1).view(np.int64)), keys], names=["bucket", "key"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        runs = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), SIZE)], pa.binary())
        names = ["key", "root", "chunk", "chunks", "copies", "sig"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [runs], names=names + ["runs"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one task (root, i, j) at a time; the rows are sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = (row["root"], row["i"], row["j"])
            if at != now and rows:
                yield rows
                rows = []
            now = at
            rows.append(row)
    if rows:
        yield rows


def _verifier(threshold: float, tolerance: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(-1, HASHES)
            sets = [np.frombuffer(r["runs"], np.uint64) for r in rows]
            across = rows[0]["i"] != rows[0]["j"]
            x, y = similar_pairs(sig, sets, np.array([r["chunk"] for r in rows]) if across else None, threshold, tolerance)
            copies = np.array([r["copies"] for r in rows], np.float64)
            links = np.bincount(x, copies[y], len(rows)) + np.bincount(y, copies[x], len(rows))
            root = _roots(len(rows), x, y)
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i]["key"] for i in hit], pa.binary()), pa.array(links[hit].astype(np.int64)), pa.array([rows[root[i]]["key"] for i in hit], pa.binary())],
                names=["key", "links", "least"])
    return lambda batches: released(verify(batches))


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id, copy_id, n_links, with root, the key of the
    class, and the key columns _d and _h of the row.

    copy_id is the least id of the documents with the same set of runs, class_id the least id of the documents
    connected by links, n_links how many other documents reach the threshold with this one, copies included.
    """
    docs = with_key(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    signed = stored(docs.mapInArrow(lambda b: released(_fingerprint(b)), "doc_id long, _d long, _h long, key binary, sig binary, bytes long"))
    classes = stored(signed.groupBy("key").agg(
        F.min(F.struct("_d", "_h")).alias("first"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"),
        F.first("sig").alias("sig"), F.first("bytes").alias("bytes")))
    bands = stored(classes.filter(F.col("sig").isNotNull()).select("key", "sig").mapInArrow(_bands, "bucket long, key binary"))
    hubs = bands.groupBy("bucket").agg(F.min("key").alias("hub"), F.max("key").alias("last")).filter("hub < last")
    near = components(bands.join(hubs.select("bucket", "hub"), "bucket").select(F.col("key").alias("u"), F.col("hub").alias("v")))
    near = near.union(near.select("root", "root").distinct()).select(F.col("node").alias("key"), "root")
    members = stored(near.join(classes, "key").select("key", "root", "copies", "sig", "bytes", F.col("first._d").alias("_d"), F.col("first._h").alias("_h")))
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("chunks"))
    members = stored(members.join(sizes, "root").select("key", "root", "chunks", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"), "copies", "sig", "_d", "_h"))
    sets = (join_measured(docs, members, ["_d", "_h"], width=100 + 4 * HASHES).dropDuplicates(["key"])
            .select("text", "key", "root", "chunk", "chunks", "copies", "sig")
            .mapInArrow(lambda b: released(_sets(b)), "key binary, root binary, chunk int, chunks int, copies long, sig binary, runs binary"))
    tasks = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tasks = tasks.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "key", "copies", "sig", "runs")
    found = stored(tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
                   .mapInArrow(_verifier(threshold, tolerance), "key binary, links long, least binary"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("key").alias("u"), F.col("least").alias("v")))
    groups = groups.union(groups.select("root", "root").distinct()).select(F.col("node").alias("key"), "root")
    ids = classes.select("key", "copy_id", "copies").join(links, "key", "left").join(groups, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = ids.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    ids = ids.join(least, "root").select("key", "root", "copy_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "_d", "_h", "key").join(ids, "key").select("doc_id", "class_id", "copy_id", "n_links", "root", "_d", "_h")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of docs with the first document, by id and then text hash, of each class; a repeated row is kept once."""
    found = similarity_join(docs, threshold, tolerance)
    first = found.groupBy("root").agg(F.min(F.struct("_d", "_h")).alias("first")).select("first._d", "first._h")
    keyed = with_key(docs.withColumn("_text", F.col("text")).withColumn("text", F.coalesce("text", F.lit(""))))
    return keyed.join(first, ["_d", "_h"]).dropDuplicates(["_d", "_h"]).withColumn("text", F.col("_text")).select(*docs.columns)

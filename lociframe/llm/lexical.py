"""Ranked lexical search by an Aho-Corasick scan of the documents, without a document index.

The terms of the items, each guarded by a space on both sides, make one automaton. A text is brought to the same form (every
ASCII character that is no letter or digit is a space, A-Z are lower case), so the automaton's hits are exactly the
occurrences of terms, and counting its outputs gives tf. Outputs map to the items that hold the term.

The documents are scanned twice and nothing of them is stored: the first scan counts the documents, their terms and how many
hold each term, the second scores every document for every item and keeps the best `top` per item and task, which
Spark merges in two steps.

Items are taken in blocks of about BLOCK_BYTES of text and at most BLOCK_ITEMS items, each with an automaton of its own, so
what is broadcast is bounded by a block and by the longest item. A score needs the terms of its own item alone, so blocks change nothing.

Items of equal id and text are one item; a null item text has no terms and no rows. Null texts have no terms. Each row of the documents
is a document, also if ids repeat; a null id comes first among equal scores. Texts of any length are scanned whole, one at a
time. Empty tables give empty results. Other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.words import released, slices

TOP = 20
BLOCK_BYTES, BLOCK_ITEMS = 2 << 20, 2048
MERGERS = 64      # tasks whose best rows are merged first
POOL = 200_000    # candidates that a task holds before it drops what cannot be among the best
NULL_ID = -(1 << 63)

# What is no ASCII letter or digit is a space, A-Z are lower case, bytes of other characters stay.
FORM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FORM).split()


@dataclass
class Block:
    """The items of a block: their terms, and for term t the items which[at[t]:at[t + 1]], each holding it often[...] times."""
    ids: list
    terms: list[bytes]
    at: np.ndarray
    which: np.ndarray
    often: np.ndarray


def block_of(items: list[tuple]) -> Block:
    """items: (item_id, text)."""
    counted = [Counter(terms_of(text)) for _, text in items]
    terms = sorted(set().union(*counted)) if counted else []
    number = {t: i for i, t in enumerate(terms)}
    rows = sorted((number[t], k, n) for k, c in enumerate(counted) for t, n in c.items())
    at = np.searchsorted([r[0] for r in rows], np.arange(len(terms) + 1)) if rows else np.zeros(1, np.int64)
    return Block([i for i, _ in items], terms, at.astype(np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))


def automaton(terms: list[bytes]):
    """Each term between two spaces; bytes stand for themselves as characters."""
    import ahocorasick
    out = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        out.add_word(f" {t.decode('latin-1')} ", k)
    out.make_automaton()
    return out


def scan(texts: pa.Array, found) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per text: how many terms it has, the item terms among them, and how often each occurs."""
    for text in texts:
        data = b"" if text is None else (text.as_buffer() or b"")
        data = b" " + bytes(data).translate(FORM) + b" "
        solid = np.frombuffer(data, np.uint8) != 32
        n = int(np.count_nonzero(solid[1:] & ~solid[:-1]))
        hits = np.fromiter((k for _, k in found.iter(data.decode("latin-1"))), np.int64) if n else np.zeros(0, np.int64)
        yield n, *np.unique(hits, return_counts=True)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _strings(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text").cast(pa.large_binary())


def count_terms(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """N, L and the df of the block's terms; a task gives one row per term that it has seen."""
    shared = docs.sparkSession.sparkContext.broadcast(block.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, df, full, total = automaton(shared.value), np.zeros(len(shared.value), np.int64), 0, 0
        for batch in slices(batches):
            for n, terms, _ in scan(_strings(batch), found):
                df[terms] += 1
                full, total = full + (n > 0), total + n
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate([seen, [-2, -1]]), "n": np.concatenate([df[seen], [full, total]])})

    rows = _texts(docs).mapInArrow(lambda b: released(count(b)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist()))
    shared.unpersist()
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(len(block.terms))], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` rows of each item with the largest scores, then the smallest ids."""
    order = np.lexsort((doc, -score, item))
    first = np.flatnonzero(np.diff(item[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order[place < top]


def score_block(docs: DataFrame, block: Block, n_docs: int, n_terms: int, df: np.ndarray, top: int = TOP) -> DataFrame:
    """(item, doc_id, score): at most `top` rows per item and task, with the best of all among them."""
    shared = docs.sparkSession.sparkContext.broadcast((block, weights(n_docs, df)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        found, n_items = automaton(own.terms), len(own.ids)
        least = np.ones(n_items, np.int64)            # what a score must reach
        pool = [np.zeros(0, np.int64)] * 3            # item, score, doc
        fresh, waiting = [], 0

        def pruned():
            item, score, doc = (np.concatenate([p, *(f[k] for f in fresh)]) for k, p in enumerate(pool))
            keep = best(item, score, doc, top)
            item, score, doc = item[keep], score[keep], doc[keep]
            full = np.bincount(item, minlength=n_items) >= top
            lowest = np.full(n_items, np.iinfo(np.int64).max)
            np.minimum.at(lowest, item, score)
            least[full] = lowest[full]
            return [item, score, doc]

        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            for doc, (n, terms, tf) in zip(ids, scan(_strings(batch), found)):
                if not len(terms):
                    continue
                m = 75 + (25 * n * n_docs) // n_terms
                part = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                sizes = own.at[terms + 1] - own.at[terms]
                flat = np.arange(sizes.sum()) + np.repeat(own.at[terms] - (np.cumsum(sizes) - sizes), sizes)
                total = np.zeros(n_items, np.int64)
                np.add.at(total, own.which[flat], np.repeat(part, sizes) * own.often[flat])
                items = np.flatnonzero(total >= least)
                fresh.append((items, total[items], np.full(len(items), doc, np.int64)))
                waiting += len(items)
                if waiting > POOL:
                    pool, fresh, waiting = pruned(), [], 0
        pool = pruned()
        yield pa.RecordBatch.from_pydict({"item": pool[0], "doc_id": pool[2], "score": pool[1]})

    return _texts(docs).mapInArrow(lambda b: released(rank(b)), "item long, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) of each block; blocks go by a hash, so their number follows the items."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    size, count = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(-(-size // BLOCK_BYTES), -(-count // BLOCK_ITEMS))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield [tuple(r) for r in rows]


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with the largest scores above 0; ties go to the smaller id."""
    out = None
    for rows in _blocks(items):
        block = block_of(rows)
        n_docs, n_terms, df = count_terms(docs, block)
        if not n_terms or not block.terms:
            continue
        found = score_block(docs, block, n_docs, n_terms, df, top)
        order = [F.desc("score"), F.asc("doc_id")]
        some = Window.partitionBy("item", "part").orderBy(*order)
        found = found.withColumn("part", F.spark_partition_id() % MERGERS).withColumn("place", F.row_number().over(some)).filter(F.col("place") <= top)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
        names = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "item").select(     # at most BLOCK_ITEMS rows
            "item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return items.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out

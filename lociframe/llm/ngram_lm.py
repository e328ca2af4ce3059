"""Language-model scoring with a sharded Elias-Fano trie of bigrams.

Tokens are words and one end per text. Every pair of neighbours (context, word) of a text goes to the shard of its context, so
one shuffle of packed pairs serves both to learn and to score. A shard counts the pairs of the training texts and lays
them out as a trie of two levels: the sorted contexts, and for all contexts together their sorted successors, a successor's
id standing on its context's number, so that the whole level is one rising sequence. Both levels and the pointers from
one to the other are Elias-Fano coded, and smoothed log probabilities and back-off weights are kept as 8-bit codes. The levels
are one buffer, written to the model's table, and read in place in the task that has built it (from a file it could be mapped
as it is): a context is found by successor search in the first level, the pointers give its range, and the word is searched in that
range alone. The order is 2: contexts are single words.

The model discounts absolutely and backs off to add-0.1 counts of single words:
  p(word | context) = (c(context, word) - D) / c(context) for a pair that was seen,
  D * T(context) / c(context) * p(word) otherwise, and p(word) after an unseen context; T counts distinct successors.
The unseen part is not normalised again, so a context's probabilities add up to at most 1.

A context that holds more than a quarter of a shard's share of all tokens is split over all shards by its successors; its count is
taken beforehand. A pair lives in one shard, so the numbers of distinct successors that the shards have are summed, and the back-off
weight is added to every text for its unseen pairs after such a context, whichever shard met them.
No task depends on one word, and nothing that grows with the corpus comes to the driver (at most four hot contexts per shard do). Words are known by 64-bit hashes, successors
by 40 bits of them.

Null and empty texts are one end. A null id stays null and takes part in training unless it is marked otherwise. Repeated rows
count as often as they stand. Without training texts nothing is known and V is 0. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.words import mix, released, split_words, word_hashes
from lociframe.session import stored

DISCOUNT, ADD = 0.75, 0.1
SHARD_TOKENS = 1_800_000
BLOCK_BYTES, BLOCK_DOCS = 6 << 20, 1 << 15
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
ID_BITS = 40
QUERIES = 1 << 17            # pairs that are looked up at once
NULL = -(1 << 63)


# Elias-Fano coding of rising sequences

class EliasFano:
    """A rising sequence: low bytes of each value as they are, high parts as a bit vector, one set bit per value."""

    def __init__(self, n: int, width: int, lows: np.ndarray, high: np.ndarray):
        self.n, self.width, self.lows, self.high = n, width, lows, high
        self.ones = None
        bits = np.unpackbits(high)
        self.zeros = np.flatnonzero(bits == 0).astype(np.int64)      # the k-th zero: the values of high part k end there

    @staticmethod
    def code(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(7, max(0, -(-max(0, (top // max(1, n)).bit_length() - 1) // 8)))
        lows = values.view(np.uint8).reshape(n, 8)[:, :width]
        high = (values >> np.uint64(8 * width)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 2, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits)
        return np.array([n, width, len(packed)], np.int64).tobytes() + lows.tobytes() + packed.tobytes()

    @staticmethod
    def at(buffer: memoryview, place: int) -> tuple[EliasFano, int]:
        n, width, size = np.frombuffer(buffer, np.int64, 3, place).tolist()
        place += 24
        lows = np.frombuffer(buffer, np.uint8, n * width, place).reshape(n, width)
        place += n * width
        return EliasFano(n, width, lows, np.frombuffer(buffer, np.uint8, size, place)), place + size

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.width):
            out |= self.lows[i, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def _bracket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the values with a high part."""
        top = len(self.zeros) - 1
        high = np.minimum(high, top)
        before = np.where(high > 0, self.zeros[np.maximum(high, 1) - 1] - (high - 1), 0)
        return np.minimum(before, self.n), np.minimum(self.zeros[high] - high, self.n)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The place of the first value that is at least x, n if there is none; or of those at first .. last, last if there is none."""
        x = x.astype(np.uint64)
        mask = np.uint64((1 << 8 * self.width) - 1)
        a, b = self._bracket(np.minimum(x >> np.uint64(8 * self.width), np.uint64(1 << 62)).astype(np.int64))
        if first is not None:
            a, b = np.clip(a, first, last), np.clip(b, first, last)
        low = x & mask
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            m = (a[open_] + b[open_]) >> 1
            less = self._low(m) < low[open_]
            a[open_] = np.where(less, m + 1, a[open_])
            b[open_] = np.where(less, b[open_], m)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        if self.ones is None:
            self.ones = np.flatnonzero(np.unpackbits(self.high)[:self.n + len(self.zeros)])
        return ((self.ones[i] - i).astype(np.uint64) << np.uint64(8 * self.width)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of x, -1 where it is not a value."""
        out = np.full(len(x), -1, np.int64)
        if self.n:
            at = self.successor(x)
            here = at < self.n
            a, b = self._bracket((x.astype(np.uint64) >> np.uint64(8 * self.width)).astype(np.int64))
            ok = here & (at < b) & (at >= a)
            ok[ok] = self._low(at[ok]) == (x[ok].astype(np.uint64) & np.uint64((1 << 8 * self.width) - 1))
            out[ok] = at[ok]
        return out


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A codebook of 256 values at equal shares of x, and the code of the nearest one of each."""
    values = np.unique(x)
    book = values if len(values) <= 256 else np.unique(np.quantile(x, np.linspace(0, 1, 256)))
    if not len(book):
        return np.zeros(256), np.zeros(0, np.uint8)
    at = np.clip(np.searchsorted(book, x), 1, max(1, len(book) - 1))
    code = np.where(np.abs(x - book[at - 1]) <= np.abs(x - book[np.minimum(at, len(book) - 1)]), at - 1, np.minimum(at, len(book) - 1))
    return np.concatenate([book, np.full(256 - len(book), book[-1])]), code.astype(np.uint8)


class Trie:
    """The levels of one shard, over a buffer that is read in place."""

    def __init__(self, buffer: bytes):
        view = memoryview(buffer)
        self.contexts, at = EliasFano.at(view, 0)
        self.pointers, at = EliasFano.at(view, at)
        self.successors, at = EliasFano.at(view, at)
        n, m = self.contexts.n, self.successors.n
        self.counts = np.frombuffer(view, np.int64, n, at)
        self.backoff_book = np.frombuffer(view, np.float64, 256, at + 8 * n)
        self.backoff_code = np.frombuffer(view, np.uint8, n, at + 8 * n + 2048)
        self.book = np.frombuffer(view, np.float64, 256, at + 9 * n + 2048)
        self.code = np.frombuffer(view, np.uint8, m, at + 9 * n + 4096)

    @staticmethod
    def build(contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, counts: np.ndarray, totals: np.ndarray, split: np.ndarray) -> bytes:
        """contexts: sorted hashes; starts: where the successors of each begin; successors: ids, sorted in each range;
        counts: of pairs; totals: of contexts; split: contexts with successors in other shards too, whose back-off weight stands
        as 1 here and in the table of split contexts as it is."""
        n = len(contexts)
        sizes = np.diff(np.append(starts, len(successors)))
        owner = np.repeat(np.arange(n), sizes)
        rising = (owner.astype(np.uint64) << np.uint64(ID_BITS)) | successors.astype(np.uint64)
        book, code = _quantised(np.log10((counts - DISCOUNT) / totals[owner])) if n else _quantised(np.zeros(0))
        back_book, back_code = _quantised(np.where(split, 0.0, np.log10(np.minimum(1.0, DISCOUNT * np.maximum(sizes, 1) / totals)))) if n else _quantised(np.zeros(0))
        levels = [EliasFano.code(contexts), EliasFano.code(np.append(starts, len(successors))), EliasFano.code(rising)]
        return b"".join([*levels, totals.astype(np.int64).tobytes(), back_book.tobytes(), back_code.tobytes(), book.tobytes(), code.tobytes()])

    def query(self, contexts: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the seen probability or of the back-off weight, whether the pair was seen)."""
        at = self.contexts.find(contexts)
        out, seen = np.zeros(len(at)), np.zeros(len(at), bool)
        known = np.flatnonzero(at >= 0)
        if len(known):
            own = at[known]
            out[known] = self.backoff_book[self.backoff_code[own]]
            first, last = self.ranges(own)
            word = (own.astype(np.uint64) << np.uint64(ID_BITS)) | successors[known].astype(np.uint64)
            place = self.successors.successor(word, first, last)
            hit = place < last
            hit[hit] = self.successors.get(place[hit]) == word[hit]
            seen[known[hit]] = True
            out[known[hit]] = self.book[self.code[place[hit]]]
        return out, seen

    def ranges(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the successors of the contexts at these places begin and end in the second level, by the pointers."""
        return self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)

    def successors_of(self, context: int) -> tuple[int, int]:
        """The range of a context's successors in the second level; empty for an unknown one."""
        at = self.contexts.find(np.array([context], np.uint64))
        if at[0] < 0:
            return 0, 0
        a, b = self.ranges(at)
        return int(a[0]), int(b[0])


# From texts to packed pairs

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, rows = [], 0, 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and (size + own > BLOCK_BYTES or rows + len(batch) > BLOCK_DOCS):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, rows = [], 0, 0
        held, size, rows = held + [batch], size + own, rows + len(batch)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _frequent(share: float, only: np.ndarray | None):
    """Per block: the words that hold a share of its tokens, or those of `only`, with counts; word 0 counts tokens, 1 texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            codes, words, at = split_words(block.column("text"), ascii_only=True)
            times = np.bincount(codes, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
            often = np.arange(len(words)) if only is not None else np.flatnonzero(times >= max(2, share * len(codes)))
            hashes = word_hashes(words.take(pa.array(often)))
            if only is not None:
                mine = np.isin(hashes, only)
                often, hashes = often[mine], hashes[mine]
            words_ = np.concatenate([hashes, np.array([0, 1], np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words_), pa.array(np.concatenate([times[often], [len(codes) + len(block), len(block)]]).astype(np.int64))], names=["word", "n"])
    return run


def _shard_of(h1: np.ndarray, h2: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return np.where(np.isin(h1, hot), mix(h1 ^ mix(h2)), mix(h1)) % np.uint64(shards)


PACKED = "shard int, block long, trained int, size int, body binary, docs binary"


def _router(shards: int, hot: np.ndarray):
    """Rows of PACKED: a block's pairs for one shard. body: sorted contexts, whether a pair begins a new context,
    48 bits of each pair's word, and per occurrence the text's number in the block, with a bit for a new pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for block in _blocks(batches):
            training = block.column("training").to_numpy(zero_copy_only=False).astype(bool)
            block = block.take(pa.array(np.argsort(~training, kind="stable")))
            codes, words, at = split_words(block.column("text"), ascii_only=True)
            hashes = np.concatenate([word_hashes(words), [BEGIN, END]]).astype(np.uint64)
            n = len(words)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(n + 2, np.int64)
            place[order] = np.arange(n + 2)
            hashes, codes = hashes[order], place[codes]
            first, second = np.insert(codes, at[:-1], place[n]), np.insert(codes, at[1:], place[n + 1])
            doc = np.repeat(np.arange(len(block)), np.diff(at) + 1)
            is_hot, own = np.isin(hashes, hot), (mix(hashes) % np.uint64(shards)).astype(np.int64)
            shard = own[first]
            split = np.flatnonzero(is_hot[first])
            shard[split] = (mix(hashes[first[split]] ^ mix(hashes[second[split]])) % np.uint64(shards)).astype(np.int64)
            key = (shard * (n + 2) + first) * (n + 2) + second
            del shard, first, second
            by = np.argsort(key, kind="stable")
            key, doc = key[by], doc[by]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            pairs = key[new]
            outer, second = np.divmod(pairs, n + 2)
            shard, first = np.divmod(outer, n + 2)
            fresh = np.concatenate([[True], outer[1:] != outer[:-1]]) if len(outer) else np.zeros(0, bool)
            begins = np.flatnonzero(new)
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            posts = (doc.astype(np.uint16) | (new.astype(np.uint16) << np.uint16(15)))
            lengths = np.diff(at) + 1
            ids = block.column("doc_id").fill_null(NULL).to_numpy(zero_copy_only=False)
            docs = np.stack([ids, lengths]).astype(np.int64).tobytes()
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                word = hashes[second[a:b]] >> np.uint64(16)
                p, q = begins[a], begins[b] if b < len(begins) else len(posts)
                contexts = hashes[first[a:b][fresh[a:b]]]
                parts = [np.array([len(contexts), b - a, q - p], np.int64), contexts, np.packbits(fresh[a:b]), (word >> np.uint64(16)).astype(np.uint32),
                         (word & np.uint64(0xFFFF)).astype(np.uint16), posts[p:q]]
                rows.append((int(shard[a]), number, int(training.sum()), len(block), b"".join(x.tobytes() for x in parts), docs if a == 0 else None))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 64]), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                                 names=[x.split()[0] for x in PACKED.split(", ")])
            number += 1
    return lambda batches: released(run(batches))


def _unpack(body: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, each pair's context among them, each pair's word, each occurrence's pair and its text)."""
    n, m, p = np.frombuffer(body, np.int64, 3).tolist()
    at = 24
    contexts = np.frombuffer(body, np.uint64, n, at)
    at += 8 * n
    fresh = np.unpackbits(np.frombuffer(body, np.uint8, -(-m // 8), at), count=m)
    at += -(-m // 8)
    word = np.frombuffer(body, np.uint32, m, at).astype(np.uint64)
    word <<= np.uint64(16)
    at += 4 * m
    word |= np.frombuffer(body, np.uint16, m, at)
    posts = np.frombuffer(body, np.uint16, p, at + 2 * m)
    return contexts, np.cumsum(fresh, dtype=np.int32) - 1, word, np.cumsum(posts >> np.uint16(15), dtype=np.int32) - 1, posts & np.uint16(0x7FFF)


# One shard

SHARD = "shard int, levels binary, words array<long>, counts array<long>, block long, size int, trained int, sums binary, docs binary, unseen array<long>, unseen_doc array<int>, hot array<long>, times array<long>"


def _lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """A column of lists; no list for None."""
    ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate([x for x in arrays if x is not None]) if any(x is not None for x in arrays) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind), mask=pa.array([x is None for x in arrays]))


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows))
    long, short = pa.int64(), pa.int32()
    arrays = [pa.array(columns[0], short), pa.array(columns[1], pa.binary()), _lists(columns[2], long), _lists(columns[3], long), pa.array(columns[4], long),
              pa.array(columns[5], short), pa.array(columns[6], short), pa.array(columns[7], pa.binary()), pa.array(columns[8], pa.binary()),
              _lists(columns[9], long), _lists(columns[10], short), _lists(columns[11], long), _lists(columns[12], long)]
    return pa.table(arrays, names=[x.split()[0] for x in SHARD.split(", ")])


def _pack_sums(value: np.ndarray, base: np.ndarray, known: np.ndarray, unseen: np.ndarray) -> bytes:
    width = np.uint16 if max(known.max(initial=0), unseen.max(initial=0)) < 1 << 16 else np.uint32
    return b"".join(x.tobytes() for x in (value.astype(np.float32), base, known.astype(width), unseen.astype(width)))


def _unpack_sums(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    width = np.uint16 if len(raw) == 16 * size else np.uint32
    at = 12 * size
    return (np.frombuffer(raw, np.float32, size), np.frombuffer(raw, np.float64, size, 4 * size),
            np.frombuffer(raw, width, size, at), np.frombuffer(raw, width, size, at + size * width().itemsize))


def _learner(hot: dict[int, int]):
    """Learns a shard's trie from the training texts of its rows, and scores all its occurrences. hot: counts of the contexts
    that are split. A shard knows its own distinct successors of a split context alone: it gives their numbers, and counts
    the unseen pairs of each text after such contexts, whose back-off is added once the numbers are summed."""
    hot_words = np.array(sorted(hot), np.uint64)
    hot_counts = np.array([hot[int(w)] for w in hot_words], np.int64)

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks = list(zip(*(table.column(c).to_pylist() for c in ("block", "size", "trained", "docs"))))
        bodies = [_unpack(b.as_buffer()) for b in table.column("body")]
        ends = np.cumsum([0] + [len(w) for _, _, w, _, _ in bodies])
        contexts, place = np.unique(np.concatenate([*(c for c, _, _, _, _ in bodies), hot_words]), return_inverse=True)
        firsts = np.cumsum([0] + [len(c) for c, _, _, _, _ in bodies])
        owner = np.concatenate([place[a:b].astype(np.int32)[own] for (_, own, _, _, _), a, b in zip(bodies, firsts, firsts[1:])])
        bodies = [(w, pair, doc) for _, _, w, pair, doc in bodies]
        times = np.concatenate([np.bincount(pair[doc < t], minlength=len(w)).astype(np.int32) for (w, pair, doc), (_, _, t, _) in zip(bodies, blocks)])
        key = owner.astype(np.uint64) << np.uint64(ID_BITS)
        for (w, _, _), a, b in zip(bodies, ends, ends[1:]):
            key[a:b] |= w >> np.uint64(48 - ID_BITS)
        # every pair once, with its number of times in the training texts
        asked, back = np.unique(key, return_inverse=True)
        del key
        back = back.astype(np.int32)
        counts = np.bincount(back, times, len(asked)).astype(np.int64)
        learned = counts > 0
        distinct, counts = asked[learned], counts[learned]
        del learned
        mine = (distinct >> np.uint64(ID_BITS)).astype(np.int64)
        counted = np.bincount(mine, counts, len(contexts)).astype(np.int64)
        hot_at = np.searchsorted(contexts, hot_words)
        total, number = counted.copy(), np.full(len(contexts), -1, np.int64)
        total[hot_at], number[hot_at] = hot_counts, np.arange(len(hot_words))
        known = np.flatnonzero(total)
        low = np.uint64((1 << ID_BITS) - 1)
        levels = Trie.build(contexts[known], np.searchsorted(mine, known), distinct & low, counts, total[known], number[known] >= 0)
        cold = known[(number[known] < 0) & (contexts[known] != BEGIN)]
        own = np.bincount(mine, minlength=len(contexts))[hot_at]
        rows = [(shard, levels, (contexts[cold] >> np.uint64(16)).astype(np.int64), total[cold], None, None, None, None, None, None, None, own, None)]
        trie = Trie(levels)
        value, seen = np.empty(len(asked)), np.empty(len(asked), bool)
        for a in range(0, len(asked), QUERIES):
            part = asked[a:a + QUERIES]
            value[a:a + QUERIES], seen[a:a + QUERIES] = trie.query(contexts[(part >> np.uint64(ID_BITS)).astype(np.int64)], part & low)
        base = np.where(contexts == BEGIN, 0.0, np.log10(total + ADD))
        is_known = (contexts != BEGIN) & (total > 0)
        for (w, pair, doc), a, b, (block, size, t, docs) in zip(bodies, ends, ends[1:], blocks):
            of_pair, of_owner = back[a:b], owner[a:b]
            missed = ~seen[of_pair][pair]
            at_hot = number[of_owner][pair[missed]]
            split = at_hot >= 0
            later, times_ = np.unique((doc[missed][split].astype(np.int64) << 32) | at_hot[split], return_counts=True)
            sums = _pack_sums(np.bincount(doc, value[of_pair][pair], size), np.bincount(doc, base[of_owner][pair], size),
                              np.bincount(doc, is_known[of_owner][pair], size).astype(np.int64), np.bincount(doc, missed, size).astype(np.int64))
            rows.append((shard, None, None, None, block, size, t, sums, docs, w[pair[missed]].astype(np.int64), doc[missed].astype(np.int32), later, times_))
        return _rows(rows)
    return lambda table: list(released(iter([run(table)])))[0]


def _assemble(table: pa.Table) -> pa.Table:
    """The texts of one block, with the sums over all shards."""
    size, trained = table.column("size")[0].as_py(), table.column("trained")[0].as_py()
    value, base, known, unseen = np.zeros(size), np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for raw in table.column("sums").to_pylist():
        parts = _unpack_sums(raw, size)
        value += parts[0]
        base += parts[1]
        known += parts[2]
        unseen += parts[3]
    ids, tokens = np.frombuffer(next(d for d in table.column("docs").to_pylist() if d is not None), np.int64).reshape(2, size)
    return pa.table({"block": pa.array(np.full(size, table.column("block")[0].as_py())), "doc": pa.array(np.arange(size, dtype=np.int32)),
                     "doc_id": pa.array(ids, mask=ids == NULL), "held_out": pa.array(np.arange(size) >= trained), "n_tokens": pa.array(tokens),
                     "known": pa.array(known), "value": pa.array(value), "base": pa.array(base), "n_unseen": pa.array(unseen)})


def learn_and_score(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(model, scores) of docs (doc_id, text, training).

    model: (shard, levels), a trie per shard. scores: doc_id, held_out (not training), n_tokens, n_known, train_tokens,
    base_score (single words alone) and score, log10 probabilities of whole texts.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce("training", F.lit(True)).alias("training"))
    training = docs.filter("training").select("text")

    def counted(share, only):
        return training.mapInArrow(_frequent(share, only), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # A word that holds a share of all tokens holds it in some block; at most 1 / share words do.
    tokens = training.select(F.lit(0)).limit(1).count() and training.agg(F.sum(F.octet_length("text") + 1)).first()[0] // 6
    shards = max(1, -(-int(tokens or 0) // shard_tokens))
    share = 1 / (4 * shards)
    rough = stored(counted(share, None))
    sums = {r["word"]: r["n"] for r in rough.filter(F.col("word").isin(0, 1)).collect()} if tokens else {}
    n, texts_ = sums.get(0, 0), sums.get(1, 0)
    # At most 8 words per shard pass: the blocks' counts of them come to half a share of all tokens.
    often = rough.filter(~F.col("word").isin(0, 1) & (F.col("n") >= share / 2 * n)).select("word").collect()
    often = np.array([r["word"] for r in often], np.int64).view(np.uint64)
    exact = {r["word"]: r["n"] for r in counted(0.0, often).collect()} if len(often) and shards > 1 else {}
    hot = {int(np.int64(w).view(np.uint64)): k for w, k in exact.items() if w not in (0, 1) and k > share * n}
    if shards > 1 and texts_ > share * n:
        hot[int(BEGIN)] = texts_
    hot_words = np.array(sorted(hot), np.uint64)
    packed = docs.mapInArrow(_router(shards, hot_words), PACKED)
    out = stored(packed.groupBy("shard").applyInArrow(_learner(hot), SHARD))
    weights = {}
    if hot:
        kinds = out.filter(F.col("levels").isNotNull()).select(F.posexplode("hot").alias("at", "k")).groupBy("at").agg(F.sum("k").alias("k"))
        for r in kinds.collect():          # a row per split context, of which there are four per shard at most
            weights[r["at"]] = float(np.log10(min(1.0, DISCOUNT * max(1, r["k"]) / hot[int(hot_words[r["at"]])])))
    tries, parts = out.filter(F.col("levels").isNotNull()), out.filter(F.col("block").isNotNull())
    known = [(w >> 16, k) for w, k in hot.items() if w != int(BEGIN)] + ([(int(END) >> 16, texts_)] if texts_ else [])
    vocabulary = tries.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    vocabulary = vocabulary.union(spark.createDataFrame(known, "word long, c long"))
    v = (tries.agg(F.sum(F.size("words"))).first()[0] or 0) + len(known)
    below = float(np.log10(n + ADD * (v + 1))) if n else float(np.log10(ADD))
    missed = parts.select("block", F.explode(F.arrays_zip("unseen", "unseen_doc")).alias("u")).select(
        F.col("u.unseen").alias("word"), F.shiftleft("block", 15).bitwiseOR(F.col("u.unseen_doc")).alias("at"))
    missed = (missed.join(vocabulary, "word", "left").groupBy("at").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("back")))
    table = spark.createDataFrame(sorted(weights.items()), "hot_at long, weight double")
    split = parts.select("block", F.explode(F.arrays_zip("hot", "times")).alias("h")).select(
        F.shiftleft("block", 15).bitwiseOR(F.shiftright(F.col("h.hot"), 32)).alias("at"), F.col("h.hot").bitwiseAND(F.lit((1 << 32) - 1)).alias("hot_at"), F.col("h.times").alias("times"))
    split = split.join(F.broadcast(table), "hot_at").groupBy("at").agg(F.sum(F.col("times") * F.col("weight")).alias("split_back"))
    whole = parts.select("block", "size", "trained", "sums", "docs").groupBy("block").applyInArrow(
        _assemble, "block long, doc int, doc_id long, held_out boolean, n_tokens long, known long, value double, base double, n_unseen long")
    end = float(np.log10(texts_ + ADD))
    scores = (whole.withColumn("at", F.shiftleft("block", 15).bitwiseOR(F.col("doc"))).join(missed, "at", "left").join(split, "at", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + (1 if texts_ else 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + end - F.col("n_tokens") * below).alias("base_score"),
        (F.col("value") + F.coalesce("back", F.lit(0.0)) + F.coalesce("split_back", F.lit(0.0)) - F.col("n_unseen") * below).alias("score")))
    return tries.select("shard", "levels"), scores

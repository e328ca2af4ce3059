"""Words of whole Arrow batches of texts, as integer codes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def split_words(texts: pa.Array, ascii_only: bool = False, bare: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, words, offsets): text k is words[codes[offsets[k]:offsets[k + 1]]]; lower case, cut at white space.

    ascii_only lower-cases A-Z and cuts at space, tab, line feed, vertical tab, form feed and return alone.
    bare takes what is neither letter nor digit off both ends of a word, and words of nothing else out.
    """
    texts = pc.fill_null(texts, "")
    # Trimmed first: the splitting kernels take white space at the very end of an array for a word.
    if ascii_only:
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    else:
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=starts[1:])
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    codes, words, at = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, kept[starts]
    if bare and len(words):
        again = pc.replace_substring_regex(words, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").dictionary_encode()
        words, codes = again.dictionary, again.indices.to_numpy(zero_copy_only=False)[codes]
        left = np.concatenate([[False], pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)])[codes + 1]
        codes, at = codes[left], np.concatenate([[0], np.cumsum(left)]).astype(np.int64)[at]
    return codes, words, at


def released(rows: Iterator) -> Iterator:
    """The rows, and then what a worker has freed is given back, so that one that waits for its next task stays small."""
    yield from rows
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches again, in batches whose texts have about `size` bytes; a longer text is a batch of its own."""
    for batch in batches:
        for a, b in pieces(batch.column("text"), size):
            yield batch.slice(a, b - a)


def pieces(texts: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of `size` words of each text; a shorter text is one run, an empty one none."""
    codes, words, at = split_words(texts)
    hashes = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        rolled += hashes[k:k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a:b - size + 1]))
        else:
            out.append(mix(np.array([(hashes[a:b] * factors[:b - a]).sum(dtype=np.uint64)], np.uint64)) if b > a else np.zeros(0, np.uint64))
    return out

"""Secret scans over a trigram inverted index.

The index is made per block of documents and written as a table: for each hashed trigram of the lower-cased bytes of
the texts, the places in the block that hold it; a row more lists the block's documents. From each rule's regular
expression a Boolean query over trigrams is derived: literals, small classes and alternatives give sets of strings,
one of which must stand in any match, and so all its trigrams. A block's postings are intersected and united as the
query says, and only the documents left are searched with the expression itself. A rule without mandatory trigrams
is put to every document. Hash collisions only add candidates.

Postings are shuffled for the trigrams of the rules alone, a block's worth to a task; texts are not shuffled
while the candidates are few enough to be broadcast (measured first), and are joined to them by a shuffle beyond that.

Spans are leftmost and non-overlapping per kind, in code points, end exclusive; a match that is too short is dropped, but
what it covers is not searched again. Null texts are empty. Rows repeated with one id and text are found alike. Other
columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import join_measured, with_key
from lociframe.llm.words import released, slices
from lociframe.session import stored

SPACE_BITS = 16          # trigrams are hashed into 2^16 lists
STRINGS, CLASS = 64, 8   # larger sets of strings, and larger classes of characters, ask for nothing


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least `least` characters; any_case ignores the case of ASCII letters."""
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.finditer(self.pattern, text, re.ASCII | re.IGNORECASE if self.any_case else re.ASCII)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


# A run of the classes of `access` and `hex` is taken whole, so their least lengths can stand in the expression.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


def _code(raw: np.ndarray) -> np.ndarray:
    """Hashed trigrams of bytes, one per place that begins one."""
    x = raw.astype(np.uint32)
    packed = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - SPACE_BITS)


def trigrams(text: str) -> frozenset[int]:
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    return frozenset(_code(raw).tolist()) if len(raw) >= 3 else frozenset()


Query = list[list[frozenset[int]]]      # all of: one of: all these trigrams


def _clause(strings: set[str]) -> Query:
    """What it asks for that one of the strings stands in a text; nothing if one of them has no trigram."""
    sets = {trigrams(s) for s in strings}
    if not all(sets):
        return []
    return [sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)]


def _derive(items) -> tuple[set[str] | None, Query]:
    """Of a parsed sequence: the strings it can match if they are few, and what any match must hold otherwise."""
    now, query, exact = {""}, [], True

    def flush():
        nonlocal now, exact
        query.extend(_clause(now))
        now, exact = {""}, False
    for op, arg in items:
        strings: set[str] | None = None
        inner: Query = []
        if op is sre.LITERAL:
            strings = {chr(arg)}
        elif op is sre.IN:
            if all(o is sre.LITERAL for o, _ in arg) and len(arg) <= CLASS:
                strings = {chr(a) for _, a in arg}
        elif op is sre.SUBPATTERN:
            strings, inner = _derive(arg[-1])
        elif op is sre.BRANCH:
            parts = [_derive(b) for b in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                needs = [_clause(s) if s is not None else q for s, q in parts]
                if all(needs):      # one clause of each branch, any of which will do
                    inner = [[t for n in needs for t in n[0]]]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            own, need = _derive(sub)
            if (low, high) == (0, 1) and own is not None:
                strings = own | {""}
            elif low == high == 1:
                strings, inner = own, need
            elif low and own is not None and low <= 32 and len(own) == 1:
                now = {s + next(iter(own)) * low for s in now}      # at least so many, one after the other
                flush()
                continue
            elif low:
                inner = need or (_clause(own) if own is not None else [])
        elif op is sre.AT:
            continue
        if strings is not None and len(strings) * len(now) <= STRINGS:
            now = {a + b for a in now for b in strings}
        else:
            flush()
            query.extend(inner if strings is None else _clause(strings))
    if exact:
        return now, []
    query.extend(_clause(now))
    return None, query


def trigram_query(rule: Rule) -> Query:
    """The Boolean trigram query of a rule; empty if it has no mandatory trigrams."""
    strings, query = _derive(_parser.parse(rule.pattern, re.ASCII))
    return _clause(strings) if strings is not None else query


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    seen = np.zeros(1 << SPACE_BITS, bool)
    for batch in slices(batches):
        lists = []
        for text in batch.column("text").to_pylist():
            raw = np.frombuffer(text.encode().lower(), np.uint8)
            if len(raw) < 3:
                lists.append(np.zeros(0, np.uint16))
                continue
            codes = _code(raw)
            seen[codes] = True
            lists.append(np.flatnonzero(seen).astype(np.uint16))
            seen[codes] = False
        codes = np.concatenate(lists)
        places = np.repeat(np.arange(len(lists), dtype=np.uint16), [len(x) for x in lists])
        order = np.argsort(codes, kind="stable")
        codes, places = codes[order], places[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        ends = np.append(starts, len(codes)).astype(np.int32) * 2
        postings = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(places.tobytes())])
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_h")], axis=1).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(starts) + 1, block)), pa.array(np.append(codes[starts].astype(np.int32), -1).astype(np.int32)),
             pa.concat_arrays([postings, pa.array([keys.tobytes()], pa.binary())])], names=["block", "trigram", "postings"])
        block += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index (block, trigram, postings) of keyed texts (_d, _h, text); trigram -1 lists the documents."""
    return stored(docs.select("_d", "_h", "text").mapInArrow(lambda b: released(_index(b)), "block long, trigram int, postings binary"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_d, _h, mask): the documents that the trigram queries leave; bit k stands for rule k."""
    queries = [trigram_query(r) for r in rules]
    wanted = sorted({t for q in queries for c in q for s in c for t in s})

    def evaluate(table: pa.Table) -> pa.Table:
        lists = dict(zip(table.column("trigram").to_pylist(), table.column("postings").to_pylist()))
        keys = np.frombuffer(lists.pop(-1), np.int64).reshape(-1, 2)
        held = {}
        for t, raw in lists.items():
            held[t] = np.zeros(len(keys), bool)
            held[t][np.frombuffer(raw, np.uint16)] = True
        none, mask = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        for k, query in enumerate(queries):
            if query:
                hit = ~none
                for clause in query:
                    any_of = none.copy()
                    for strings in clause:
                        any_of |= np.logical_and.reduce([held.get(t, none) for t in strings])
                    hit &= any_of
                mask |= hit.astype(np.int64) << k
        on = np.flatnonzero(mask)
        return pa.table({"_d": keys[on, 0], "_h": keys[on, 1], "mask": mask[on]})
    return (index.filter(F.col("trigram").isin(-1, *wanted)).groupBy("block")
            .applyInArrow(evaluate, "_d long, _h long, mask long").dropDuplicates(["_d", "_h"]))


def _verify(rules: tuple[Rule, ...]):
    full = [not trigram_query(r) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, mask in zip(batch.column("text").to_pylist(), batch.column("mask").to_pylist()):
                mask = mask or 0
                found = [(a, k, b) for k, r in enumerate(rules) if full[k] or mask >> k & 1 for a, b in r.spans(text)]
                out.append([{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(found)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])
    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): every document with its spans (kind, start, end), by start and then order of the rules."""
    keyed = with_key(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    found = stored(candidates(build_index(keyed), rules))
    return (join_measured(keyed, found, ["_d", "_h"], "left").select("doc_id", "text", "mask")
            .mapInArrow(_verify(rules), "doc_id long, spans array<struct<kind: string, start: long, end: long>>"))

"""SentencePiece encoding and decoding by a streaming Viterbi search.

A prefix of a text is reached by its last piece; the search keeps, for each of the last places up to the longest
piece, the best last piece and where it begins. Whenever the backpointer paths of all places that a later
piece can still begin at meet in one place, the pieces before it are final: they are given out and
forgotten, so memory does not grow with the text.

Two kinds of vocabulary are scored. A unigram vocabulary has a score per piece, and the largest sum wins. A merge (BPE)
vocabulary has no additive score; there a step from one piece to the next has weight 0 if the two, merged
alone, stay these two pieces, and is ruled out otherwise. Every prefix then has exactly one path, and it
is the result of the merges on the whole text.

As the public library does it, a space is put in front, spaces become `\\u2581`, and a character that is in no piece is
written as its UTF-8 bytes, where the vocabulary has byte pieces. A `\\u2581` of the text itself is written as bytes too,
so decoding gives every text back exactly.

Where no piece of the vocabulary reaches past the end of a word, every path passes there: the paths meet, and the ids so far are
final. The search is therefore begun anew there, and what it gave for a run between two such places is remembered, up to a bounded
number of short runs; every other run, however long, goes through the window.

Null texts are empty and have no ids. Very long texts and words need no more memory than short ones, besides their
ids. Repeated rows are encoded each. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.words import released

SPACE = "▁"
HEAD = 6
WORDS, PAIRS = 300_000, 600_000      # remembered runs (as many again of the generation before) and pairs of pieces per worker
REMEMBERED = 64                      # characters of the longest run whose ids are remembered
STRETCH = 1 << 16                    # characters of a text that are cut into runs at once


def load(path: str, kind: str = "bpe") -> Vocabulary:
    """The vocabulary of a SentencePiece model file; kind is bpe or unigram."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    byte_ids = [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        else:
            pieces[piece] = (i, model.get_score(i))
    return Vocabulary(pieces, byte_ids, model.unk_id(), kind)


class Vocabulary:
    """Pieces with ids and scores; byte_ids[b] is the id of byte b, or -1."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int, kind: str = "bpe"):
        self.pieces, self.byte_ids, self.unknown, self.kind = pieces, byte_ids, unknown, kind
        self.longest = max(map(len, pieces), default=1)
        self.least = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids) if i >= 0}
        whole_words = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        alone = "" if any("\n" in p for p in pieces) else r"\n"
        self.cut = re.compile(f"{SPACE}| *[^ {SPACE}{alone}]+| +" + (f"|{alone}" if alone else "") if whole_words else f"{SPACE}|[^{SPACE}]+")
        self.suffixes = {p[i:] for p in pieces for i in range(len(p))}
        self.words: dict[str, tuple[int, ...]] = {}
        self.heads: dict[str, tuple[tuple[str, ...], tuple[int, ...]]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.stable: dict[tuple[str, str], bool] = {}

    def __reduce__(self):
        return Vocabulary, (self.pieces, self.byte_ids, self.unknown, self.kind)

    def forget(self) -> None:
        """Drop what was remembered of words. A worker keeps it for its next task; it is bounded by WORDS and PAIRS, not by the texts."""
        for known in (self.words, self.older, self.heads, self.stable):
            known.clear()

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a short text: the best scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                known = self.pieces.get(parts[i] + parts[i + 1])
                if known is not None and (best is None or known[1] > best):
                    best, at = known[1], i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: str, right: str) -> bool:
        """Whether merging the two pieces together leaves them as they are; left may be empty."""
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            known = self.stable[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def ids(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        if known is not None:
            return [known[0]]
        raw = [self.byte_ids[b] for b in piece.encode()]
        return raw if min(raw) >= 0 else [self.unknown]

    def search(self, parts: Iterator[str]) -> Iterator[int]:
        """Ids of a stream of text, given in parts of any size, each id as soon as it is final."""
        held, before = "", ""                       # characters that are not final, and the last final piece
        last, back, score = [""], [0], [0.0]        # of each place in held: best last piece, its begin, its score
        window = self.longest
        for part in parts:
            fresh = not held and not before
            if fresh and part[:HEAD] in self.heads:     # beginnings alike share their first places
                last, back, score = map(list, self.heads[part[:HEAD]])
            held += part
            self._advance(held, before, last, back, score)
            if fresh and len(part) >= HEAD and part[:HEAD] not in self.heads:
                if len(self.heads) >= WORDS:
                    self.heads.clear()
                self.heads[part[:HEAD]] = tuple(last[:HEAD + 1]), tuple(back[:HEAD + 1]), tuple(score[:HEAD + 1])
            if len(held) >= 4 * window:
                # A later piece begins at one of the last places; where the paths from all of them meet, what lies before is final.
                live = set(range(len(held) - window + 1, len(held) + 1))
                while len(live) > 1:
                    place = max(live)
                    live.discard(place)
                    live.add(back[place])
                meet = live.pop()
                if meet:
                    pieces = self._path(last, back, meet)
                    for p in pieces:
                        yield from self.ids(p)
                    before, held = pieces[-1], held[meet:]
                    last, back, score = last[meet:], [max(0, b - meet) for b in back[meet:]], [s - score[meet] for s in score[meet:]]
        for p in self._path(last, back, len(held)):
            known = self.pieces.get(p)
            if known is None:
                yield from self.ids(p)
            else:
                yield known[0]

    def _advance(self, held: str, before: str, last: list[str], back: list[int], score: list[float]) -> None:
        """The best last piece of every place of held that has none yet; pieces are sought in a window of the longest one."""
        pieces, suffixes, stable, longest, follows = self.pieces, self.suffixes, self.stable, self.longest, self.follows
        for end in range(len(last), len(held) + 1):
            floor = max(-1, end - 1 - longest)
            if self.kind == "bpe":
                at = back[-1]                                           # most often the last piece grows by a character
                piece = held[at:end]
                if end > 1 and at > floor and piece in pieces and (stable.get((last[at] if at else before, piece)) or follows(last[at] if at else before, piece)):
                    last.append(piece)
                    back.append(at)
                    score.append(0.0)
                    continue
                choice, at = held[end - 1], end - 1     # where no merge ends: only for vocabularies that are not built by merges
                for a in range(end - 1, floor, -1):
                    piece = held[a:end]
                    if piece in pieces or a == end - 1:
                        left = last[a] if a else before
                        fits = stable.get((left, piece))
                        if fits or fits is None and follows(left, piece):
                            choice, at = piece, a
                            break
                    elif piece not in suffixes:
                        break
                last.append(choice)
                back.append(at)
                score.append(0.0)
                continue
            best = None
            for a in range(end - 1, floor, -1):
                piece = held[a:end]
                known = pieces.get(piece)
                if known is None and a < end - 1:
                    if piece not in suffixes:
                        break
                    continue
                total = score[a] + (known[1] if known else self.least)
                if best is None or total > best[0]:
                    best = total, a, piece
            score.append(best[0])
            back.append(best[1])
            last.append(best[2])

    @staticmethod
    def _path(last: list[str], back: list[int], place: int) -> list[str]:
        out = []
        while place:
            out.append(last[place])
            place = back[place]
        return out[::-1]

    def _searched(self, run: str) -> tuple[int, ...]:
        """Ids of a run that no piece reaches over: at its end all paths meet, so they are final and may be remembered."""
        known = self.older.get(run)
        if known is None:
            if run == SPACE:
                return tuple(i if i >= 0 else self.unknown for i in (self.byte_ids[b] for b in SPACE.encode()))
            size = 4 * self.longest
            known = tuple(self.search(run[k:k + size].replace(" ", SPACE) for k in range(0, len(run), size)))
            if len(run) > REMEMBERED:
                return known
        if len(self.words) >= WORDS:
            self.older, self.words = self.words, {}
        self.words[run] = known
        return known

    def runs(self, text: str) -> Iterator[list[str]]:
        """text, in lists of runs that no piece reaches over; a list has about STRETCH characters, or one longer run."""
        at = 0
        while at < len(text):
            found = self.cut.findall(text, at, at + STRETCH)
            if at + STRETCH < len(text):
                found.pop()                       # it may go on
            if not found:
                found = [self.cut.match(text, at)[0]]
            yield found
            at += sum(map(len, found))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if text:
            for found in self.runs(" " + text):
                for run in found:
                    out.extend(self.words.get(run) or self._searched(run))
        return out

    def decode(self, ids) -> str:
        known = self.bytes_of
        text = b"".join([known.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            flat: list[int] = []
            ends, digests, exact = [0], [], []
            for text in batch.column("text").to_pylist():
                ids = vocabulary.encode(text)
                back = vocabulary.decode(ids)
                flat += ids
                ends.append(len(flat))
                digests.append(hashlib.sha256(back.encode()).hexdigest())
                exact.append(back == text)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            counts = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, ids, pa.array(digests, pa.string()), pa.array(exact, pa.bool_())],
                                             names=["doc_id", "n_ids", "ids", "decoded_sha256", "exact"])
    return lambda batches: released(run(batches))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256 (of the text that the ids decode to), exact (whether that is the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)     # bounded by the vocabulary, not the documents
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(_encoder(shared), "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, exact boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded with text, what its ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return pa.array([shared.value.decode(x or []) for x in ids.to_pylist()], pa.string())
    return encoded.withColumn("text", text("ids"))

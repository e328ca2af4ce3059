"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage of every text.

A text is cut into passages that overlap by half and are twice as long as the longest item, so an item
stands whole in one of them. Items are scored with BM25, as a share of the score of the item's own text. The index
holds a term's items with their impacts, and the largest impact per block of items. As in block-max WAND, a
passage is first bounded from the rare terms alone: the common terms together can add at most a known share, so a
block whose bound stays below the threshold is never scored. All passages of a batch are bounded and scored
together, in arrays. Every pair above the threshold is kept and verified: enough of the runs of three words of the
question and of the answer together must stand in the passage. Neither part is required by itself, as one edited word
makes a short part unlike, and a text may hold an item without its last sentence.

Items are taken in shards of at most SHARD_ITEMS items and SHARD_BYTES of text, sorted by length; each shard is
an index of its own, with the statistics of all items, and is put to all texts. So memory is bounded for any
benchmark, and nothing that grows with the documents is collected.

Null and empty texts and items match nothing. Items with a null id are items. A repeated item counts once; a repeated
document is reported once per row. Words are lower-cased, cut at white space and bared of marks at
their ends. Other columns are left out, or kept
by `clean`, which returns the rows of texts without a leak as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.words import pieces, slices, split_words
from lociframe.session import stored

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, RUN = 0.6, 0.6, 3
COMMON = 0.3                   # what the common terms may add to any item's share
BLOCK, SHARD_ITEMS, SHARD_BYTES = 32, 4096, 16 << 20
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
                                 T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()),
                                 T.StructField("start_word", T.LongType())]))


def split_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, question, answer) of items (item_id, text): the answer is the last sentence, the question what precedes it."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    cut = F.regexp_extract(text, r"(?s)^(.*[.!?])\s+(\S.*)$", 1)
    return benchmark.select("item_id", F.when(cut == "", text).otherwise(cut).alias("question"),
                            F.when(cut == "", "").otherwise(F.regexp_replace(F.substr(text, F.length(cut) + 1), r"^\s+", "")).alias("answer"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        codes, words, at = split_words(batch.column("text"), bare=True)
        item = np.repeat(np.arange(len(batch)), np.diff(at))
        pairs, times = np.unique(item * max(1, len(words)) + codes, return_counts=True)
        item, code = np.divmod(pairs, max(1, len(words)))
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(item)), words.take(pa.array(code)), pa.array(times.astype(np.int64))], names=["item", "term", "tf"])


def item_terms(items: DataFrame) -> tuple[DataFrame, float, float]:
    """Items with their terms (term, tf, df), the number of items, and their mean length in words."""
    items = (items.select("item_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer")).distinct()
             .withColumn("text", F.concat_ws(" ", "question", "answer")).withColumn("item", F.sha2(F.to_json(F.struct("item_id", "question", "answer")), 256)))
    counts = stored(items.select("item", "text").mapInArrow(_terms, "item string, term string, tf long"))
    n, words = counts.agg(F.countDistinct("item"), F.sum("tf")).first()
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = counts.join(df, "term").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("term", "tf", "df"))).alias("terms"), F.sum("tf").alias("words"))
    return items.join(terms, "item").select("item_id", "item", "question", "answer", "terms", "words"), float(n), (words or 0) / max(1, n)


def _words(text: str) -> list[str]:
    codes, words, _ = split_words(pa.array([text]), bare=True)
    return words.take(pa.array(codes)).to_pylist()


def _runs(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + RUN]) for i in range(len(words) - RUN + 1)} if len(words) >= RUN else ({tuple(words)} if words else set())


class Index:
    """Postings of one shard: impacts as shares of each item's own score, sorted by term and item."""

    def __init__(self, rows: list, n_items: float, mean_words: float):
        self.ids = [r["item_id"] for r in rows]
        self.longest = max(r["words"] for r in rows)
        self.questions, self.answers = ([_runs(_words(r[c])) for r in rows] for c in ("question", "answer"))
        vocabulary: dict[str, int] = {}
        item, term, impact, df = [], [], [], {}
        for i, r in enumerate(rows):
            own = []
            for t in r["terms"]:
                idf = np.log(1 + (n_items - t["df"] + 0.5) / (t["df"] + 0.5))
                own.append(idf * t["tf"] * (K1 + 1) / (t["tf"] + K1 * (1 - B + B * r["words"] / mean_words)))
                term.append(vocabulary.setdefault(t["term"], len(vocabulary)))
                df[term[-1]] = t["df"]
                item.append(i)
            impact += [x / sum(own) for x in own]
        self.vocabulary = vocabulary
        order = np.lexsort((item, term))
        self.item, self.impact, term_ = np.array(item)[order], np.array(impact)[order], np.array(term)[order]
        self.starts = np.searchsorted(term_, np.arange(len(vocabulary) + 1))
        # Common terms, the most frequent first, as long as together they stay below COMMON for every item.
        self.rare, common = np.ones(len(vocabulary), bool), np.zeros(len(rows))
        for t in sorted(df, key=lambda t: (-df[t], t)):
            a, b = self.starts[t], self.starts[t + 1]
            if (common[self.item[a:b]] + self.impact[a:b]).max() <= COMMON:
                common[self.item[a:b]] += self.impact[a:b]
                self.rare[t] = False
        self.blocks = -(-len(rows) // BLOCK)
        self.slack = np.array([common[b * BLOCK:(b + 1) * BLOCK].max() for b in range(self.blocks)])
        key = term_ * self.blocks + self.item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.block, self.block_max = (key % self.blocks)[first], np.maximum.reduceat(self.impact, first)
        self.block_starts = np.searchsorted(term_[first], np.arange(len(vocabulary) + 1))

    @staticmethod
    def _expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of terms, posting) for all postings of the terms."""
        n = starts[terms + 1] - starts[terms]
        which = np.repeat(np.arange(len(terms)), n)
        return which, np.repeat(starts[terms] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(which))

    def search(self, passage: np.ndarray, term: np.ndarray, passages: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, share) of all pairs at the threshold; passage and term list each passage's distinct terms once, sorted."""
        rare = self.rare[term]
        which, post = self._expand(self.block_starts, term[rare])
        bound = np.bincount(passage[rare][which] * self.blocks + self.block[post], self.block_max[post], passages * self.blocks).reshape(passages, self.blocks)
        p, b = np.nonzero(bound >= threshold - self.slack - 1e-9)
        if not len(p):
            return p, p, np.zeros(0)
        slot = np.full((passages, self.blocks), -1, np.int32)
        slot[p, b] = np.arange(len(p))
        live = np.zeros(passages, bool)
        live[p] = True
        mine = live[passage]
        passage, term = passage[mine], term[mine]
        which, post = self._expand(self.starts, term)
        at = slot[passage[which], self.item[post] // BLOCK]
        on = at >= 0
        share = np.bincount(at[on] * BLOCK + self.item[post][on] % BLOCK, self.impact[post][on], len(p) * BLOCK)
        hit = np.flatnonzero(share >= threshold - 1e-9)
        return p[hit // BLOCK], b[hit // BLOCK] * BLOCK + hit % BLOCK, share[hit]

    def leaks(self, texts: pa.Array, threshold: float, overlap: float) -> list[list[dict]]:
        """The leaks of each text, one per item, in the order of the items."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        codes, words, at = split_words(texts, bare=True)
        if not len(codes):
            return out
        known = np.array([self.vocabulary.get(w, -1) for w in words.to_pylist()])
        term, length, step = known[codes], np.diff(at), self.longest
        doc = np.repeat(np.arange(len(texts)), length)
        place = np.arange(len(codes)) - at[doc]
        mine = term >= 0
        doc, place, term = doc[mine], place[mine], term[mine]
        count = np.maximum(1, (length + step - 1) // step - 1)     # passages of each text
        first = np.concatenate([[0], np.cumsum(count)])
        part = place // step
        here, before = part < count[doc], part > 0
        passage = np.concatenate([(first[doc] + part)[here], (first[doc] + part - 1)[before]])
        pairs = np.unique(passage * len(self.vocabulary) + np.concatenate([term[here], term[before]]))
        passage, term = np.divmod(pairs, len(self.vocabulary))
        found: dict[tuple[int, int], dict] = {}
        cuts = np.searchsorted(passage, np.arange(0, first[-1] + 4096, 4096))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):     # blocks of passages bound the grids of `search`
            low = k * 4096
            for p, i, share in zip(*self.search(passage[a:b] - low, term[a:b], int(min(4096, first[-1] - low)), threshold)):
                d = int(np.searchsorted(first, p + low, side="right") - 1)
                start = int(p + low - first[d]) * step
                own = words.take(pa.array(codes[at[d] + start:min(at[d + 1], at[d] + start + 2 * step)])).to_pylist()
                runs, question, answer = _runs(own), self.questions[i], self.answers[i]
                in_q, in_r = (len(x & (runs if max(map(len, x)) == RUN else _short(own, x))) if x else 0 for x in (question, answer))
                q, r = (n / len(x) if x else 1.0 for n, x in ((in_q, question), (in_r, answer)))
                if (in_q + in_r) / (len(question) + len(answer)) >= overlap and share > found.get((d, int(i)), {"score": -1.0})["score"]:
                    found[d, int(i)] = {"item_id": self.ids[i], "score": round(float(share), 9), "question_overlap": q, "answer_overlap": r, "start_word": start}
        for (d, _), leak in sorted(found.items()):
            out[d].append(leak)
        return out


def _short(own: list[str], wanted: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """The runs of an item part of fewer than RUN words that stand in a passage."""
    return {w for w in wanted if any(tuple(own[i:i + len(w)]) == w for i in range(len(own) - len(w) + 1))}


def indexes(items: DataFrame) -> Iterator[Index]:
    """One index per shard of items (item_id, question, answer)."""
    terms, n, mean = item_terms(items)
    rows, size = [], 0
    for r in terms.orderBy("words", "item").toLocalIterator():
        own = len(r["question"]) + len(r["answer"])
        if rows and (len(rows) == SHARD_ITEMS or size + own > SHARD_BYTES):
            yield Index(rows, n, mean)
            rows, size = [], 0
        rows.append(r)
        size += own
    if rows:
        yield Index(rows, n, mean)


def leaks_of(spark, index: Index, threshold: float, overlap: float):
    """A function of a text column that lists its leaks."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(LEAK)
    def found(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("start_word", pa.int64())]))
        return pa.array([x for a, b in pieces(text, 1 << 20) for x in shared.value.leaks(text[a:b], threshold, overlap)], kind)
    return found


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, start_word) of every leak."""
    spark, parts = docs.sparkSession, []
    for index in indexes(items):
        parts.append(stored(docs.select("doc_id", F.explode(leaks_of(spark, index, threshold, overlap)(F.coalesce("text", F.lit("")))).alias("leak")).select("doc_id", "leak.*")))
    if not parts:
        return docs.select("doc_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in LEAK.elementType)).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns."""
    spark, before = docs.sparkSession, None
    for index in indexes(items):
        docs = docs if before is None else stored(docs)
        docs = before = docs.filter(F.size(leaks_of(spark, index, threshold, overlap)(F.coalesce("text", F.lit("")))) == 0)
    return docs

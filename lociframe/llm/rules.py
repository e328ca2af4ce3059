"""Quality rules over whole documents, with DataFrame functions alone.

Base rules look at one text: its words (runs of anything but ASCII white space), symbols, repeated lines and
repeated windows of five words. They are computed in the row, without a shuffle: windows are hashed and sorted with their
places, so a text of n words takes n log n steps, however often a window repeats.

The cross-document rule looks at lines. A line is normalised (lower case, runs of white space are one space, runs of
digits one 0) and hashed; per host the distinct documents that hold it are counted, equal texts being one document.
Lines in more than `min_docs` documents of a host, and in more than `share` of them, are boilerplate there and are
removed; a document is depleted when fewer than MIN_WORDS words or less than `least` of its words are left. Counting starts
with one row per (host, line, text) and is summed in two steps, so a line that a third of all documents hold is
never gathered.

Null texts are empty: no words, rejected. A null host is a host. Rows repeated with one id, text and host are one document
and get one verdict each. Texts without a line break are one line. Empty tables give empty results. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import join_measured, with_key
from lociframe.session import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 20
MIN_DOCS, SHARE, LEAST = 10, 0.001, 0.5


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row also where a lambda inside refers to it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of `window` words that occur twice or more, the first occurrence included."""
    def grams(h):
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0))),
                           lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(at):      # at: rising places of repeated windows
        return F.aggregate(F.transform(at, lambda a, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - a, F.lit(window)))),
                           F.lit(0).cast("long"), lambda total, x: total + x)

    def places(s):        # s: (window, place) in order, so equal windows are neighbours
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(
            (F.get(s, i + 1)["g"] == x["g"]) | (F.when(i > 0, F.get(s, i - 1)["g"]) == x["g"]), F.lit(False))), lambda x: x["at"]))

    def count(g):
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), _let(pairs, lambda s: _let(places(s), covered))).otherwise(F.lit(0).cast("long"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(grams(h), count))


def base_rules(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    def of_words(words):
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                        repeated_words(words).alias("n_repeat_words"))
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")

    def joined(w):
        failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEATED * w["n_words"])
        return F.struct(w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"),
                        _let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                        w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"))
    return _let(_let(words_of(text), of_words), joined)


def normalised_lines(text: Column) -> Column:
    """The normalised lines of a text, in order; a line without a word is empty."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]+", "0")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """(_d, _h, _s, text): the key of a document with its host, and its text."""
    return with_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(host).alias("_s")))


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(_s, line, n_docs): hashes of a host and of a line that more distinct documents of it hold than both limits allow."""
    keyed = _keyed(docs, host)
    sizes = keyed.select("_s", "_h").distinct().groupBy("_s").agg(F.count(F.lit(1)).alias("docs"))
    held = keyed.select("_s", "_h", F.explode(F.array_distinct(F.transform(F.filter(normalised_lines(F.col("text")), lambda x: x != ""), lambda x: F.xxhash64(x)))).alias("line"))
    counts = held.distinct().groupBy("_s", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > min_docs)
    return counts.join(sizes, "_s").filter(F.col("n_docs") > share * F.col("docs")).select("_s", "line", "n_docs")


def removed_lines(docs: DataFrame, frequent: DataFrame, host: str = "source") -> DataFrame:
    """(_d, _h, _s, removed, removed_words): the numbers of a document's frequent lines, rising, and their words."""
    lines = _keyed(docs, host).select("_d", "_h", "_s", F.posexplode(F.transform(normalised_lines(F.col("text")), lambda x: F.struct(
        F.xxhash64(x).alias("line"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("words")))).alias("no", "x"))
    lines = lines.select("_d", "_h", "_s", "no", F.col("x.line").alias("line"), F.col("x.words").alias("words")).filter("words > 0")
    hits = join_measured(lines, frequent.select("_s", "line"), ["_s", "line"], width=16).dropDuplicates(["_d", "_h", "_s", "no"])
    return hits.groupBy("_d", "_h", "_s").agg(F.sort_array(F.collect_list("no")).alias("removed"), F.sum("words").alias("removed_words"))


def without_lines(text: Column, removed: Column) -> Column:
    """text without the lines of the given rising numbers: what lies between two of them is one slice."""
    def kept(lines):
        starts = F.concat(F.array(F.lit(-1)), removed)
        return F.flatten(F.transform(starts, lambda r, i: F.slice(lines, r + 2, F.coalesce(F.get(removed, i), F.size(lines)) - r - 1)))
    return F.array_join(_let(F.split(text, "\n"), kept), "\n")


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, the base rules, removed (line numbers), removed_words, kept_text (without the
    frequent lines), depleted, kept."""
    frequent = stored(frequent_lines(docs, host, min_docs, share))
    removed = stored(removed_lines(docs, frequent, host))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(host).alias("_s"))
    rows = with_key(keyed).select("doc_id", "_d", "_h", "_s", "text", base_rules(F.col("text")).alias("base"))
    none = F.array().cast("array<int>")
    out = join_measured(rows, removed, ["_d", "_h", "_s"], "left", width=F.size("removed") * 4 + 48).select(
        "doc_id", "base.*", F.coalesce("removed", none).alias("removed"), F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), "text")
    left = F.col("n_words") - F.col("removed_words")
    out = out.withColumn("depleted", (left < MIN_WORDS) | (left < least * F.col("n_words")))
    return out.select(*[c for c in out.columns if c != "text"], F.when(F.size("removed") == 0, F.col("text")).otherwise(without_lines(F.col("text"), F.col("removed"))).alias("kept_text"),
                      (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))

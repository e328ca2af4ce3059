"""Line dedup: maximal runs of lines that stand earlier in the corpus too are deleted.

The corpus is one sequence of line ids with a break after every document. Its suffixes are ranked by
distributed prefix doubling: the rank by 2^(k+1) lines comes from the pair of ranks by 2^k lines at a place
and 2^k lines further on. Only places whose first 2^k lines occur elsewhere stay in the table of a level, so
lines that are unique leave at once and the tables shrink with k; a level's ranks are the places of its suffixes in
the suffix array of what repeats.

Going back down, the levels give the longest-common-prefix intervals: a node is a set of suffixes that share
their first `depth` lines. At level k each tries the 2^k lines that follow; those that agree with another one
move to a deeper node, and the earliest of them also stays behind, to stand for them all. A suffix that is not
the earliest of its node begins a later copy of `depth` lines, and its deepest such node gives the longest copy, a
maximal repeated run. Runs of at least `words` words are deleted there; the first copy stays.

Both ways are joins and groupings of narrow rows; a frequent line is counted on the map side and no group is ever
gathered. Prefix sums run inside buckets of the rank, so no window covers a group or the table.

Earlier means a smaller id, then a smaller hash of the text, then a smaller line number; a null id is the least. Rows
repeated with one id and text are one document and are trimmed alike. Null texts are empty and stay null. Lines are cut
at line feeds and compared exactly. Other columns, whatever their names, come through untouched.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.common import with_key
from lociframe.session import stored

WORDS = 50
BUCKET = 1 << 14
AT = ["_d", "_h", "no"]


def _ranked(classes: DataFrame, order: list[str]) -> DataFrame:
    """classes (bucket, n, keys) with rank: how many suffixes sort before. Buckets sort as their rows do."""
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = classes.groupBy("bucket").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    return classes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, "bucket").withColumn("rank", F.col("offset") + F.col("inside")).drop("bucket", "inside", "offset")


def line_table(docs: DataFrame) -> DataFrame:
    """(_d, _h, no, a, b): every line of every document once, with a 128-bit id."""
    keyed = with_key(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    lines = keyed.select("_d", "_h", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.select(*AT, F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b")).dropDuplicates(AT)


def repeated_levels(lines: DataFrame) -> list[DataFrame]:
    """Level k: (_d, _h, no, rank, n) of the places whose first 2^k lines occur n > 1 times."""
    classes = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("bucket", F.shiftrightunsigned("a", 48))
    # The buckets follow the unsigned order of a: flip its sign bit.
    ranks = _ranked(stored(classes.withColumn("unsigned", F.col("a").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))), ["unsigned", "b"])
    level = stored(lines.join(ranks.select("a", "b", "rank", "n"), ["a", "b"]).select(*AT, "rank", "n"))
    levels, k = [], 0
    while not level.isEmpty():
        levels.append(level)
        total = level.count()
        ahead = level.select("_d", "_h", (F.col("no") - (1 << k)).alias("no"), F.col("rank").alias("next"))
        pairs = stored(level.join(ahead, AT))
        # A group's ranks fill rank .. rank + n, so the next rank, scaled into that space, orders the buckets.
        spread = F.col("rank") + F.floor(F.col("next") / F.lit(float(total)) * F.col("old"))
        classes = (pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("old")).filter("n > 1")
                   .withColumn("bucket", F.floor(spread / BUCKET)).withColumnRenamed("rank", "head"))
        ranks = _ranked(stored(classes), ["head", "next"]).select("head", "next", "rank", "n")
        level = stored(pairs.select(*AT, F.col("rank").alias("head"), "next").join(ranks, ["head", "next"]).select(*AT, "rank", "n"))
        k += 1
    return levels


def later_copies(levels: list[DataFrame]) -> DataFrame | None:
    """(_d, _h, no, length): the longest run from each place that also begins at an earlier place."""
    states, root, found = None, None, []
    node = ["depth", "fd", "fh", "fno"]
    for k in reversed(range(len(levels))):
        level = levels[k]
        fresh = level.join(levels[k + 1].select(*AT), AT, "leftanti") if k + 1 < len(levels) else level
        if root is not None:
            fresh = fresh.unionByName(level.join(root, AT))
        none = F.lit(0).cast("long")
        tried = fresh.select(*AT, F.lit(0).alias("depth"), none.alias("fd"), none.alias("fh"), F.lit(-1).alias("fno"), F.lit(0).alias("length"), "rank")
        if states is not None:
            steps = level.select("_d", "_h", F.col("no").alias("to"), "rank")
            old = states.withColumn("to", F.col("no") + F.col("depth")).join(steps, ["_d", "_h", "to"], "left").select(*AT, *node, "length", "rank")
            tried = tried.unionByName(old)
        tried = stored(tried)
        groups = (tried.filter(F.col("rank").isNotNull()).groupBy(*node, "rank").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(*AT)).alias("first"))
                  .filter("size > 1").drop("size"))
        both = stored(tried.join(groups, [*node, "rank"], "left"))
        moved = both.filter(F.col("first").isNotNull())
        earliest = (F.col("_d") == F.col("first._d")) & (F.col("_h") == F.col("first._h")) & (F.col("no") == F.col("first.no"))
        deeper = F.col("depth") + (1 << k)
        down = moved.select(*AT, deeper.alias("depth"), F.col("first._d").alias("fd"), F.col("first._h").alias("fh"), F.col("first.no").alias("fno"),
                            F.when(earliest, F.col("length")).otherwise(deeper).alias("length"))
        stay = both.filter(F.col("first").isNull() | earliest).select(*AT, *node, "length")
        states = stored(down.unionByName(stay.filter("depth > 0")))
        root = stay.filter("depth = 0").select(*AT)
    if states is None:
        return None
    return states.groupBy(*AT).agg(F.max("length").alias("length")).filter("length > 0")


@F.arrow_udf(T.StructType([T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())]))
def _cut(text: pa.Array, runs: pa.Array, words: pa.Array) -> pa.Array:
    out = []
    for t, own, least in zip(text.to_pylist(), runs.to_pylist(), words.to_pylist()):
        if t is None or not own:
            out.append({"removed": [], "text": t})
            continue
        lines = t.split("\n")
        size = [0]
        for line in lines:
            size.append(size[-1] + len(line.split()))
        end, drop = 0, []
        for run in sorted(own, key=lambda r: r["no"]):
            a, b = run["no"], run["no"] + run["length"]
            if size[b] - size[a] >= least:
                drop += range(max(a, end), b)
                end = max(end, b)
        gone = set(drop)
        out.append({"removed": drop, "text": "\n".join(x for i, x in enumerate(lines) if i not in gone)})
    return pa.array(out, pa.struct([("removed", pa.list_(pa.int32())), ("text", pa.string())]))


def _own(name: str, columns: list[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def dedup_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with the later copies of repeated runs of at least `words` words cut out of text, and removed_lines, their numbers."""
    copies = later_copies(repeated_levels(stored(line_table(docs))))
    if copies is None:
        return docs.withColumn("removed_lines", F.array().cast("array<int>"))
    d, h, runs, cut = (_own(n, docs.columns) for n in ("_run_d", "_run_h", "_runs", "_cut"))
    per_doc = stored(copies.groupBy(F.col("_d").alias(d), F.col("_h").alias(h)).agg(F.collect_list(F.struct("no", "length")).alias(runs)))
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")), h: F.xxhash64(F.coalesce("text", F.lit("")))})
    once = _cut.asNondeterministic()      # a filter on its result must not run it a second time
    out = keyed.join(per_doc, [d, h], "left").withColumn(cut, once("text", runs, F.lit(words)))
    kept = [F.col(f"{cut}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "removed_lines"]
    return out.select(*kept, F.col(f"{cut}.removed").alias("removed_lines"))

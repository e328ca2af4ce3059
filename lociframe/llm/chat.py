"""Chat formatting out of reply trees, with DataFrame functions alone.

A node answers its parent; every path from a root to a leaf is one possible conversation. Paths are
enumerated by self-joins of doubling step: a table of jumps of 1, 2, 4, ... ancestors is joined to the
pairs (leaf, node) known so far, so a path of n turns takes about log2(n) joins and no list grows
while they run. Branches are ranked by their mean score, and each chosen path becomes one text.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` per turn. In a role or text a backslash is doubled and
`<|` is written `<\\|`, so no marker can stand inside; in a role a line break is `\\n` (two characters).
The loss mask lists the spans (code points, end exclusive) of the escaped texts of the trained role.

Nulls: a null role or text is empty, a null tree id is a tree of its own, a null order comes first.
A parent that is missing makes its child a root. Repeated rows are turns of their own. Empty tables give
empty results. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of escape: between doubled backslashes, a backslash only ever stands before a bar or n."""
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def as_trees(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as nodes (tree, node, parent, role, text, score): each turn answers the one before."""
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(at).cast("long")
    return (rows.select("conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("tree"), node.alias("node"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
        .withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)}))


def _same(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    return a["tree"].eqNullSafe(b["_tree"]) & (a[left] == b[right])


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node of every root-to-leaf path, up steps above its leaf."""
    links = nodes.select("tree", "node", "parent")
    there = links.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    jumps = stored(links.join(there, _same(links, there, "parent", "_node"), "leftsemi").select("tree", "node", F.col("parent").alias("up")))
    parents = jumps.select(F.col("tree").alias("_tree"), F.col("up").alias("_node")).distinct()
    pairs = stored(links.join(parents, _same(links, parents, "node", "_node"), "leftanti")
                   .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    step, limit = 1, jumps.count()
    while not jumps.isEmpty():
        if step > limit:
            raise ValueError("a node is its own ancestor")
        ups = jumps.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"))
        above = pairs.join(ups, _same(pairs, ups, "node", "_node")).select("tree", "leaf", F.col("_up").alias("node"), F.col("up") + step)
        pairs = stored(pairs.union(above))
        jumps = stored(jumps.join(ups, _same(jumps, ups, "up", "_node")).select("tree", "node", F.col("_up").alias("up")))
        step *= 2
    return pairs


def format_trees(nodes: DataFrame, branches: int | None = None, trained: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, rank, n_turns, formatted, mask.

    nodes has (tree, node, parent, role, text, score). The paths of a tree are ranked by mean score, then
    by leaf; branches is how many of them are kept, None keeps all.
    """
    nodes = stored(nodes)
    known = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "role", "text", "score")
    found = paths(nodes)
    turns = found.join(known, _same(found, known, "node", "_node"))
    of_path = Window.partitionBy("tree", "leaf")
    ranked = (turns.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    ranked = ranked.select(F.col("tree").alias("_tree"), F.col("leaf").alias("_leaf"), "rank")
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turns = (turns.join(ranked, _same(turns, ranked, "leaf", "_leaf"))
             .select("tree", "leaf", "rank", (-F.col("up")).alias("at"), "role", head.alias("head"), escape(F.col("text")).alias("body")))
    size = F.length("head") + F.length("body") + len(END)
    end = F.sum(size).over(of_path.orderBy("at"))
    turns = turns.withColumn("_end", end - len(END)).select(
        "tree", "leaf", "rank", F.struct("at", F.concat("head", "body", F.lit(END)).alias("text"),
                                         (F.col("role") == trained).alias("on"),
                                         (F.col("_end") - F.length("body")).alias("start"), F.col("_end").alias("end")).alias("turn"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select(
        "tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.text", "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["on"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("mask"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    turns = F.slice(F.split(formatted, r"<\|im_end\|>\n"), F.lit(1), F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)

    def turn(t):
        head = F.substring_index(t, "\n", 1)
        return F.struct(unescape(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescape(F.substr(t, F.length(head) + 2)).alias("text"))
    return F.transform(turns, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["end"] - m["start"]))), "")

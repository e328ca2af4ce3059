"""Prefix trie of conversations, its subtrees summed up by the Euler-tour technique.

Every distinct sequence of first turns is a node. A turn's digest, hashed with its place, is a pair of 64-bit numbers; the
exclusive or of a conversation's first d pairs names its node of depth d, and taking the last pair out again names the
parent, so nodes come from one grouping and no path is walked. (Pairs are cut from SHA-256, so unlike sequences share a
name with a probability of 2^-128.)

A node v has two arcs: enter (2v) and exit (2v + 1). The arc after enter(v) is the enter arc of its first child, or exit(v) for a
leaf; the arc after exit(v) is the enter arc of the next sibling, or the exit arc of the parent. `list_rank` ranks this
list: some arcs are splitters, every other arc jumps ahead by doubling steps until it meets one, the splitters are ranked the
same way, and the others take their rank from the splitter they met. With ranks, leaves and savings are prefix sums over
arc positions, in parts of equal size, and a subtree is the difference between its two arcs.

Whatever runs along an order (turns of a conversation, children of a node) is cut into parts of bounded size by Spark's range
partitioning, and only sums cross their borders, so one conversation or one node may hold any share of the rows. Member ids are
put together in chunks, which a task streams through the digest in order.

Rows without a conversation id belong to no conversation and are left out. A null turn comes first; a null role or text is
empty; equal turns are ordered by the digest of role and text, repeated rows are turns of their own. No conversations, no nodes:
an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.common import join_measured
from lociframe.session import stored

PART_ROWS = 100_000       # rows of one order that are gone through together
SPLITTER = 16             # one arc in so many is a splitter
BASE = 1 << 16            # arcs that one task ranks
SCAN = 16                 # bits of positions per part of the prefix sums
CHUNK = 12                # bits of ids per chunk of a digest


def _lane(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long")


def turn_table(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size) of rows (conv_id, turn, role, text): a digest of role and text, and the bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256)
    return rows.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))


def _in_parts(df: DataFrame, order: list) -> DataFrame:
    """df, stored, with _part: numbers of parts of about PART_ROWS rows that never fall along the order."""
    kept = stored(df)
    n = -(-kept.count() // PART_ROWS)
    if n <= 1:
        return kept.withColumn("_part", F.lit(0))
    return stored(kept.repartitionByRange(2 * n, *order).withColumn("_part", F.spark_partition_id()))


def _carried(parts: DataFrame, group: str, sums: dict, across) -> DataFrame:
    """(group, _part, sums) of the groups that lie in more than one part: `across` of what is in their other parts.

    At most two groups of a part reach over a border, so there are no more rows than borders twice.
    """
    totals = parts.groupBy(group, "_part").agg(*[v.alias(k) for k, v in sums.items()])
    several = totals.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group))).filter("_n > 1")
    order = Window.partitionBy(group).orderBy("_part")
    return stored(several.select(group, "_part", *[across(k, order).alias(f"_{k}") for k in sums]))


def numbered(turns: DataFrame) -> DataFrame:
    """turns with no, the place of a turn in its conversation from 1."""
    order = [F.asc_nulls_first("turn"), "digest"]
    parts = _in_parts(turns, ["conv_id", *order])
    before = _carried(parts, "conv_id", {"n": F.count(F.lit(1))}, lambda k, w: F.sum(k).over(w) - F.col(k))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order))
    out = parts.withColumn("no", inside.cast("long"))
    return join_measured(out, before, ["conv_id", "_part"], "left").select("conv_id", (F.col("no") + F.coalesce("_n", F.lit(0))).alias("no"), "digest", "size")


def with_shared_heads(turns: DataFrame, step: int = 5, most: int = 9) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % step, then c's own after its first h; h = crc32(c) % most."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % step).alias("base"), head.alias("h"))
    first = turns.filter(F.col("no") < most).withColumnRenamed("conv_id", "base")
    taken = ids.join(first, "base").filter("no <= h").select("conv_id", "no", "digest", "size")
    own = turns.filter(F.col("no") > head)       # the numbers may skip some where the base is short; only their order counts
    return taken.unionByName(own.select("conv_id", "no", "digest", "size"))


def named(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, a, b, size): (x, y) names the node of a conversation's first depth turns, (a, b) its last turn."""
    parts = _in_parts(turns, ["conv_id", "no"])
    before = _carried(parts, "conv_id", {"n": F.count(F.lit(1))}, lambda k, w: F.sum(k).over(w) - F.col(k))
    w = Window.partitionBy("conv_id", "_part").orderBy("no")
    placed = join_measured(parts.withColumn("at", F.row_number().over(w).cast("long")), before, ["conv_id", "_part"], "left")
    depth = F.col("at") + F.coalesce("_n", F.lit(0))
    pair = F.sha2(F.concat_ws(":", depth.cast("string"), F.col("digest")), 256)
    lanes = placed.select("conv_id", "_part", "size", depth.alias("depth"), pair.alias("pair")).select("*", _lane(F.col("pair"), 0).alias("a"), _lane(F.col("pair"), 1).alias("b")).drop("pair")
    w = Window.partitionBy("conv_id", "_part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    lanes = stored(lanes.withColumns({"x": F.bit_xor("a").over(w), "y": F.bit_xor("b").over(w)}))
    carry = _carried(lanes, "conv_id", {k: F.bit_xor(k) for k in "ab"}, lambda k, w: F.bit_xor(k).over(w).bitwiseXOR(F.col(k)))
    out = join_measured(lanes, carry, ["conv_id", "_part"], "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "depth", F.col("x").bitwiseXOR(F.coalesce("_a", zero)).alias("x"), F.col("y").bitwiseXOR(F.coalesce("_b", zero)).alias("y"), "a", "b", "size")


def next_siblings(nodes: DataFrame) -> DataFrame:
    """(id, next): the next child of the same parent by id, null for the last."""
    children = nodes.filter("parent is not null").select("parent", "id")
    parts = _in_parts(children, ["parent", "id"])
    after = _carried(parts, "parent", {"first": F.min("id")}, lambda k, w: F.lead(k).over(w))
    inside = F.lead("id").over(Window.partitionBy("parent", "_part").orderBy("id"))
    return join_measured(parts.withColumn("inside", inside), after, ["parent", "_part"], "left").select("id", F.coalesce("inside", "_first").alias("next"))


def _rank_few(links: DataFrame) -> DataFrame:
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        arc = table["arc"].to_numpy()
        order = np.argsort(arc)
        ends = table["to"].is_null().to_numpy()
        targets = table["to"].fill_null(-1).to_numpy()
        at = np.where(ends, np.arange(len(arc)), order[np.minimum(np.searchsorted(arc[order], targets), len(arc) - 1)])
        far = np.where(ends, 0, table["dist"].to_numpy())
        while True:      # all arcs jump together
            then = far + far[at]
            if (then == far).all():
                break
            far, at = then, at[at]
        yield pa.RecordBatch.from_pydict({"arc": arc, "rank": far})
    return links.coalesce(1).mapInArrow(rank, "arc long, rank long")


def list_rank(links: DataFrame, base: int = BASE, level: int = 0) -> DataFrame:
    """(arc, rank): how far each arc is from the end of its list. links: arc, to (null at the end), dist (to `to`)."""
    links = stored(links)
    if links.count() <= base:
        return stored(_rank_few(links))
    split = F.pmod(F.xxhash64(F.lit(level), "arc"), F.lit(SPLITTER)) == 0
    marked = stored(links.withColumn("split", split | F.col("to").isNull()))
    # An arc is met once it points to a splitter; the end points nowhere.
    splitters = marked.filter("split").select(F.col("arc").alias("to"), F.lit(True).alias("met"))
    state = stored(marked.join(splitters, "to", "left").withColumn("met", F.coalesce("met", F.col("to").isNull())).select("arc", "to", "dist", "met"))
    done, open_ = [state.filter("met")], state.filter("not met")
    while not open_.isEmpty():
        known = open_
        for d in done:
            known = known.unionByName(d)
        ahead = known.select(F.col("arc").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("met").alias("_met"))
        step = stored(open_.drop("met").join(ahead, "to").select("arc", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_met").alias("met")))
        done, open_ = [*done, step.filter("met")], step.filter("not met")
    met = done[0]
    for d in done[1:]:
        met = met.unionByName(d)
    met = stored(met.drop("met").join(marked.select("arc", "split"), "arc"))
    few = list_rank(met.filter("split").select("arc", "to", "dist"), base, level + 1)
    others = met.filter("not split").join(few.select(F.col("arc").alias("to"), F.col("rank").alias("_rank")), "to")
    return stored(few.unionByName(others.select("arc", (F.col("dist") + F.col("_rank")).alias("rank"))))


def prefix_sums(arcs: DataFrame, columns: list[str]) -> DataFrame:
    """arcs (position, ...) with each column summed up to and with its row; positions are dense, so parts have equal sizes."""
    parts = arcs.withColumn("_part", F.shiftright("position", SCAN))
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns])
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)       # a row per 65,536 positions
    base = stored(totals.select("_part", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_{c}") for c in columns]))
    inside = Window.partitionBy("_part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumns({c: F.sum(c).over(inside) for c in columns})
    return join_measured(summed, base, ["_part"]).select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in arcs.columns])


def euler_tour(nodes: DataFrame) -> DataFrame:
    """(arc, to, dist): the tour of nodes (id, parent, first: the least child)."""
    enter = nodes.select((2 * F.col("id")).alias("arc"), F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1).alias("to"))
    ways = nodes.select("id", "parent").join(next_siblings(nodes), "id", "left")
    leave = ways.select((2 * F.col("id") + 1).alias("arc"), F.coalesce(2 * F.col("next"), 2 * F.col("parent") + 1).alias("to"))
    return enter.unionByName(leave).withColumn("dist", F.lit(1).cast("long"))


def subtree_sums(nodes: DataFrame, columns: list[str], base: int = BASE) -> DataFrame:
    """(id, columns): each column summed over a node and all below it. nodes: id, parent (null at the root), first, columns."""
    ranks = list_rank(euler_tour(nodes), base)
    last = ranks.agg(F.max("rank")).first()[0]
    own = nodes.select((2 * F.col("id")).alias("arc"), *columns)
    arcs = ranks.join(own, "arc", "left").select("arc", (F.lit(last) - F.col("rank")).alias("position"), *[F.coalesce(c, F.lit(0)).alias(c) for c in columns],
                                                 *[F.coalesce(c, F.lit(0)).alias(f"own_{c}") for c in columns])
    sums = prefix_sums(stored(arcs), columns)
    is_exit = F.col("arc") % 2 == 1
    return sums.groupBy(F.shiftright("arc", 1).alias("id")).agg(*[F.sum(F.when(is_exit, F.col(c)).otherwise(F.col(f"own_{c}") - F.col(c))).alias(c) for c in columns])


def id_digests(members: DataFrame, key: str = "id") -> DataFrame:
    """(key, sha256) of the decimal conv_ids per key, ascending and comma-joined.

    Ids are joined in chunks of 2^CHUNK neighbouring values; one task streams the chunks of a key, in order, through the digest.
    """
    chunks = (members.groupBy(key, F.shiftright("conv_id", CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
              .select(key, "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pydict({key: [o[0] for o in out], "sha256": [o[1] for o in out]})
        if state is not None:
            yield pa.RecordBatch.from_pydict({key: [now], "sha256": [state.hexdigest()]})

    dealt = chunks.repartition(key).sortWithinPartitions(key, "chunk").select(key, "ids")
    return dealt.mapInArrow(digest, f"{key} long, sha256 string")


def trie(convs: DataFrame, turns: DataFrame, base: int = BASE) -> DataFrame:
    """One row per node: id, parent, conv_id (the least member), parent_conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs (conv_id) are all conversations, also those without turns; turns are (conv_id, no, digest, size), no rising along a conversation.
    """
    convs = stored(convs.select("conv_id").distinct())
    places = stored(named(turns))
    groups = places.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("a").alias("a"), F.min("b").alias("b"), F.min("size").alias("size"))
    zero = F.lit(0).cast("long")
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
            .select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("a"), zero.alias("b"), zero.alias("size")))
    # Stored with its ids: a number that a task gave out is read again, never made again.
    found = stored(groups.unionByName(root).withColumn("id", F.monotonically_increasing_id()))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = found.withColumns({"px": F.col("x").bitwiseXOR(F.col("a")), "py": F.col("y").bitwiseXOR(F.col("b"))})
    linked = stored(linked.join(above, ["depth", "px", "py"], "left").select("id", "parent", "parent_conv_id", "conv_id", "depth", "x", "y", "n_convs", "size"))
    children = linked.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"), F.min("id").alias("first"))
    nodes = stored(linked.join(children, "id", "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "leaf": F.when(F.col("first").isNull(), 1).otherwise(0).cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("size")}))
    if nodes.isEmpty():
        sums = nodes.select("id", "leaf", "saved")
    else:
        sums = subtree_sums(nodes.select("id", "parent", "first", "leaf", "saved"), ["leaf", "saved"], base)
    last = places.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("depth", "x", "y")])
    ends = id_digests(ends.join(nodes.select("id", "depth", "x", "y"), ["depth", "x", "y"]).select("id", "conv_id"))
    sums = sums.select("id", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return nodes.drop("leaf", "saved").join(sums, "id").join(ends, "id", "left").select(
        "id", "parent", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))

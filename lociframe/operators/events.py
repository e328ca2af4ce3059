"""Call logs: matching two logs, one timeline, phases, status."""

from __future__ import annotations

import fnmatch
from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.running import running
from lociframe.session import stored
from lociframe.sources.logs import canonical_json

SLACK_MS = 5000


def match_events(uses: DataFrame, calls: DataFrame, slack_ms: int = SLACK_MS) -> DataFrame:
    """Pairs of two logs: use_id, call_id, how.

    uses has use_id, tool, args, ts_ms, end_ms (NULL when unknown); calls call_id, tool, args, ts_ms. A
    call fits a use when it starts at most slack before the use and at most slack after its
    end; without a time on one side it fits with a gap of 0. Arguments are compared as JSON. Uses and calls of equal tool and arguments are paired one-to-one, calls at or after the
    use before earlier ones, then by the smallest gap, then by number (how = "arguments"). A use whose arguments
    no call of its tool has takes the earliest free call of the tool that fits (how = "order").

    Taking the smallest gap first nests the pairs like brackets: with the events of a group in time order, a use opens, and a
    call closes the last use that is open. The running number of open uses is the depth of an event, and at each depth uses and
    calls take turns, so a pair is found by a join on (group, depth, number of the use at that depth); see _nested. What
    remains is paired the same way with calls before uses. Running numbers are taken in parts of bounded size, so a busy group
    or a use without an end costs no more than others.

    Gaps of 0 for want of a time are paired before all others: calls without a time with the uses of their group in
    the order of numbers, then uses without a time with the calls that are left. By order, only events with a time are paired.
    """
    by = ["tool", "args"]
    uses, calls = (x.withColumn("args", canonical_json("args")) for x in (uses, calls))
    all_calls = calls
    untimed = _untimed_pairs(uses, calls, by)
    if untimed is not None:
        uses, calls = uses.join(untimed, "use_id", "left_anti"), calls.join(untimed, "call_id", "left_anti")
    uses, calls = stored(uses.where("ts_ms is not null")), stored(calls.where("ts_ms is not null"))
    until = (F.coalesce("end_ms", F.lit(1 << 62)) + slack_ms).alias("until")
    # Groups with both kinds alone can have pairs.
    both = uses.select(*by).distinct().join(calls.select(*by).distinct(), by)
    events = stored(uses.select(*by, "ts_ms", F.lit(0).alias("kind"), F.col("use_id").alias("id"), until)
              .unionByName(calls.select(*by, "ts_ms", F.lit(1).alias("kind"), F.col("call_id").alias("id"), F.lit(None).cast("long").alias("until")))
              .join(both, by, "left_semi"))
    # Of uses at one time the smallest number is on top, so it comes last.
    after = _nested(events, by, F.when(F.col("kind") == 0, -F.col("id")).otherwise(F.col("id")), 0, F.col("close_ts") <= F.col("until"), True)
    after = after.select(F.col("open").alias("use_id"), F.col("close").alias("call_id"))
    rest = stored(events.join(after.select(F.col("use_id").alias("id"), F.lit(0).alias("kind")), ["id", "kind"], "left_anti")
            .join(after.select(F.col("call_id").alias("id"), F.lit(1).alias("kind")), ["id", "kind"], "left_anti"))
    # A call opens, and all wait equally long: whatever encloses a pair that is too far apart is farther apart itself.
    before = _nested(rest, by, F.when(F.col("kind") == 1, -F.col("id")).otherwise(F.col("id")), 1, F.col("close_ts") - F.col("open_ts") <= slack_ms, False)
    exact = after.unionByName(before.select(F.col("close").alias("use_id"), F.col("open").alias("call_id")))
    if untimed is not None:
        exact = exact.unionByName(untimed)
    exact = exact.withColumn("how", F.lit("arguments"))
    return exact.unionByName(_by_order(uses, calls, exact, slack_ms, all_calls.select("tool", "args").distinct()))


def _nested(events: DataFrame, by: list[str], tie: Column, opener: int, fits: Column, late: bool) -> DataFrame:
    """(open, close): the pairs of opening and closing events that nest like brackets and fit; stored. events are stored.

    With late, an opening event gives up once `until` has passed, and what closes it closes the one below. Events that have
    no closing event in their time give up at once. Beyond those, a pair that does not fit and encloses no other such pair
    is sure to give up; pairs that fit and enclose none are final; the rest is matched again. Each pass settles all such pairs
    of all groups, so there are as many passes as pairs that give up lie inside each other.
    """
    order = ["ts_ms", F.col("kind") != opener, "_tie"]
    now, found = events.withColumn("_tie", tie), []
    opens, most = F.col("kind") == opener, events.count()
    while True:
        if late:
            now = running(now, by, order, {"_closed": ("sum", F.when(opens, 0).otherwise(1))}, most=most)
            next_ = now.where(~opens).select(*by, (F.col("_closed") - 1).alias("_closed"), F.col("ts_ms").alias("_next"))
            ahead = now.where(opens).join(next_, [*by, "_closed"])
            now = stored(now.where(~opens).drop("_closed").unionByName(ahead.where(F.col("_next") <= F.col("until")).drop("_closed", "_next")))
        deep = running(now, by, order, {"_open": ("sum", F.when(opens, 1).otherwise(-1))}, most=most)
        deep = deep.withColumn("_depth", F.col("_open") + F.when(opens, 0).otherwise(1)).drop("_open")
        turns = stored(running(deep, [*by, "_depth"], order, {"_turn": ("sum", F.when(opens, 1).otherwise(0))}, most=most))
        key = [*by, "_depth", "_turn"]
        pairs = stored(turns.where(opens).select(*key, F.col("id").alias("open"), F.col("ts_ms").alias("open_ts"), "until").join(
            turns.where(~opens).select(*key, F.col("id").alias("close"), F.col("ts_ms").alias("close_ts")), key).withColumn("ok", fits))
        if not late or pairs.where("not ok").isEmpty():
            found.append(pairs.where("ok").select("open", "close"))
            return stored(reduce(DataFrame.unionByName, found))
        # How many of the opening events up to each event belong to pairs that do not fit.
        marks = pairs.where("not ok").select(F.col("open").alias("id"), F.lit(opener).alias("kind"), F.lit(1).alias("_bad"))
        bad = stored(running(now.join(marks, ["id", "kind"], "left"), by, order, {"_below": ("sum", F.coalesce("_bad", F.lit(0)))}, most=most))
        at = bad.select("id", "kind", "_below")
        inner = pairs.join(at.where(opens).select(F.col("id").alias("open"), F.col("_below").alias("_a")), "open").join(
            at.where(~opens).select(F.col("id").alias("close"), F.col("_below").alias("_b")), "close")
        inner = stored(inner.where(F.col("_a") == F.col("_b")).select("open", "close", "ok"))
        found.append(inner.where("ok").select("open", "close"))
        gone = inner.select(F.col("open").alias("id"), F.lit(opener).alias("kind")).unionByName(
            inner.where("ok").select(F.col("close").alias("id"), F.lit(1 - opener).alias("kind")))
        now = stored(now.join(gone, ["id", "kind"], "left_anti"))


def _numbered(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df with k, the place of a row in its group by a whole number; counts per range of numbers come first, so that
    only the rows of one range are ordered together."""
    ranges = df.withColumn("_r", F.shiftright(F.col(order), 16))
    counts = ranges.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "_r", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_r").orderBy(order))
    return ranges.join(counts, [*by, "_r"]).withColumn("k", F.col("_before") + inside).drop("_r", "_before")


def _untimed_pairs(uses: DataFrame, calls: DataFrame, by: list[str]) -> DataFrame | None:
    """(use_id, call_id) of the pairs in which a side has no time; None where every event has one."""
    late_uses, late_calls = uses.where("ts_ms is null"), calls.where("ts_ms is null")
    if late_calls.isEmpty() and late_uses.isEmpty():
        return None
    first = stored(_numbered(uses, by, "use_id").join(_numbered(late_calls, by, "call_id").select(*by, "call_id", "k"), [*by, "k"]).select("use_id", "call_id"))
    rest_uses, rest_calls = late_uses.join(first, "use_id", "left_anti"), calls.join(first, "call_id", "left_anti")
    second = _numbered(rest_uses, by, "use_id").join(_numbered(rest_calls, by, "call_id").select(*by, "call_id", "k"), [*by, "k"]).select("use_id", "call_id")
    return stored(first.unionByName(second))


def _by_order(uses: DataFrame, calls: DataFrame, exact: DataFrame, slack: int, logged: DataFrame) -> DataFrame:
    """Uses without a logged call of their arguments, in order, each with the earliest call of the tool that is left and fits.

    With calls and uses numbered in their orders, and first(k) the first call that is not too early for use k, the calls taken are
    at(k) = max(at(k - 1) + 1, first(k)) = k + the running maximum of first(j) - j, as long as every use finds one in time. Uses
    with equal maxima queue behind each other; queues without a miss are settled by that formula, and those with one go
    through a task in order, call by call.
    """
    left = uses.join(exact.select("use_id"), "use_id", "left_anti").join(logged, ["tool", "args"], "left_anti")
    free = calls.join(exact.select("call_id"), "call_id", "left_anti").join(left.select("tool").distinct(), "tool", "left_semi")
    # A use stands at the earliest time that a call may have, before the calls of that time.
    rows = left.select("tool", (F.col("ts_ms") - slack).alias("at"), F.lit(0).alias("kind"), F.col("use_id").alias("id"),
                       (F.coalesce("end_ms", F.lit(1 << 62)) + slack).alias("until")).unionByName(
        free.select("tool", F.col("ts_ms").alias("at"), F.lit(1).alias("kind"), F.col("call_id").alias("id"), F.lit(None).cast("long").alias("until")))
    rows = stored(rows)
    most = rows.count()
    placed = stored(running(rows, ["tool"], ["at", "kind", "id"], {"calls": ("sum", F.col("kind"))}, most=most))
    taken = placed.where("kind = 1").select("tool", F.col("calls").alias("number"), F.col("id").alias("call_id"), F.col("at").alias("call_ts"))
    first = placed.where("kind = 0").select("tool", "at", "id", "until", (F.col("calls") + 1).alias("number"))
    able = first.join(taken, ["tool", "number"]).where("call_ts <= until").select("tool", "at", "id", "until", "number")
    queued = running(able, ["tool"], ["at", "id"], {"k": ("sum", F.lit(1))}, most=most)
    queued = running(queued, ["tool"], ["at", "id"], {"queue": ("max", F.col("number") - F.col("k"))}, most=most)
    settled = stored(queued.select("tool", "queue", "k", "at", "id", "until", (F.col("k") + F.col("queue")).alias("number")).join(taken, ["tool", "number"], "left")
                     .withColumn("ok", F.coalesce(F.col("call_ts") <= F.col("until"), F.lit(False))))
    missed = stored(settled.where("not ok").select("tool", "queue").distinct())
    direct = settled.join(missed, ["tool", "queue"], "left_anti").select(F.col("id").alias("use_id"), "call_id")
    slow = settled.join(missed, ["tool", "queue"], "left_semi").repartition("tool", "queue").sortWithinPartitions("tool", "queue", "k")
    one_by_one = slow.select("tool", "queue", "at", "until", "id", "call_id", "call_ts").mapInArrow(_queue, "use_id long, call_id long")
    return direct.unionByName(one_by_one).withColumn("how", F.lit("order"))


def _queue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queues of uses in order; a row also brings the next call. What is kept is the calls that uses so far have missed."""
    now, waiting = None, deque()
    for batch in batches:
        out = []
        for tool, queue, at, until, use, call, call_ts in zip(*(batch.column(c).to_pylist() for c in range(7))):
            if (tool, queue) != now:
                now, waiting = (tool, queue), deque()
            if call is not None:
                waiting.append((call_ts, call))
            while waiting and waiting[0][0] < at:
                waiting.popleft()
            if waiting and waiting[0][0] <= until:
                out.append((use, waiting.popleft()[1]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["use_id", "call_id"])


def timeline(uses: DataFrame, calls: DataFrame, pairs: DataFrame, slack_ms: int = SLACK_MS) -> DataFrame:
    """All events in one order: ts_ms, kind, seq, status, use_id, call_id, tool.

    Uses with their call ("matched", "matched_by_order") or without ("transcript_only"), calls without
    a use ("call_log_only"). Calls outside the span of the uses, widened by the slack, are another
    session's: status "outside", without a place in the order (kind 2).
    """
    span = uses.agg(F.struct((F.min("ts_ms") - slack_ms).alias("lo"), (F.max("ts_ms") + slack_ms).alias("hi"))).scalar()
    left = uses.join(pairs, "use_id", "left").select(
        "ts_ms", F.lit(0).alias("kind"), F.col("use_id").alias("seq"),
        F.when(F.col("call_id").isNull(), "transcript_only").when(F.col("how") == "order", "matched_by_order")
        .otherwise("matched").alias("status"), "use_id", "call_id", "tool")
    alone = calls.join(pairs.select("call_id"), "call_id", "left_anti").withColumn("_s", span)
    outside = (F.col("ts_ms") < F.col("_s.lo")) | (F.col("ts_ms") > F.col("_s.hi"))
    right = alone.select(
        "ts_ms", F.when(outside, 2).otherwise(1).alias("kind"), F.col("call_id").alias("seq"),
        F.when(outside, "outside").otherwise("call_log_only").alias("status"),
        F.lit(None).cast("long").alias("use_id"), "call_id", "tool")
    return left.unionByName(right).orderBy("ts_ms", "kind", "seq")


def timeline_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def label_phase(df: DataFrame, rules: Sequence[tuple[str, str]], default: str = "Analysis", tool: str = "tool") -> DataFrame:
    """Adds phase: the label of the first rule whose name equals the tool or whose glob matches it."""
    out = None
    for pattern, label in rules:
        hit = (F.col(tool) == pattern) | F.col(tool).rlike("^" + fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$"))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return df.withColumn("phase", F.lit(default) if out is None else out.otherwise(default))


def call_status(df: DataFrame, seconds: str = "seconds", flag: str = "is_error", result: str = "result") -> DataFrame:
    """Adds duration (never negative, to the millisecond), error (the flag, or an object result with a
    key "error"), and state: missing, truncated (only the head was logged), or ok."""
    res = F.col(result)
    keys = F.coalesce(F.json_object_keys(F.when(F.ltrim(res).startswith("{"), res)), F.array().cast("array<string>"))
    cut = (F.get_json_object(res, "$.truncated") == "true") & F.array_contains(keys, "head")
    return df.withColumns({
        "duration": F.round(F.greatest(F.col(seconds), F.lit(0.0)), 3),
        "error": F.coalesce(F.col(flag), F.lit(False)) | F.array_contains(keys, "error"),
        "state": F.when(res.isNull(), "missing").when(F.coalesce(cut, F.lit(False)), "truncated").otherwise("ok"),
        "truncated_bytes": F.when(cut, F.get_json_object(res, "$.bytes").try_cast("long"))})

"""Edges learned at run time: what a probe saw first, and how long it is believed.

Events are rows (tid, ts, event, fn, ...): "enter" opens a call, "hit" names a function that ran in it, "exit" closes it.
The first hit between enter and exit, within a time limit, is what the call resolved to; without one it timed out. The
batch form and the streaming form agree on streams whose events arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import TTL_DAYS, valid_until
from plumbline.operators.report import one_row

TIMEOUT_S = 5.0


def first_hits(events: DataFrame, timeout_s: float = TIMEOUT_S, enter: str = "enter", hit: str = "hit", exit_: str = "exit") -> DataFrame:
    """tid, entered, hit_at, hit_fn of every call; hit_at and hit_fn are null for a timeout. Events go by ts, then ord.

    One pass: calls are numbered by their enters, so a thread's events are sorted once.
    """
    w = Window.partitionBy("tid").orderBy("ts", "ord")
    numbered = events.withColumn("_call", F.sum(F.when(F.col("event") == enter, 1).otherwise(0)).over(w)).where(F.col("_call") > 0)
    kind = F.col("event")
    calls = numbered.groupBy("tid", "_call").agg(
        F.min(F.when(kind == enter, F.col("ts"))).alias("entered"),
        F.min(F.when(kind == exit_, F.struct("ts", "ord"))).alias("closed"),
        F.min(F.when(kind == hit, F.struct("ts", "ord", "fn"))).alias("h"),
    )
    late = F.col("h.ts").cast("double") - F.col("entered").cast("double") > timeout_s
    after = F.struct(F.col("h.ts"), F.col("h.ord")) > F.col("closed")
    fine = F.col("h").isNotNull() & ~late & ~F.coalesce(after, F.lit(False))
    return calls.select("tid", "entered", F.when(fine, F.col("h.ts")).alias("hit_at"), F.when(fine, F.col("h.fn")).alias("hit_fn"))


_OUT = "tid string, entered timestamp, hit_at timestamp, hit_fn string"
_STATE = "entered timestamp"


def stream_first_hits(events: DataFrame, timeout_s: float = TIMEOUT_S, delay: str = "10 seconds") -> DataFrame:
    """first_hits on a stream: state is the open call of each thread; event time past the limit ends it without a hit."""
    limit_ms = int(timeout_s * 1000)
    limit = np.timedelta64(limit_ms, "ms")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened = np.datetime64(state.get[0], "us") if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"tid": [key[0]], "entered": [opened], "hit_at": [None], "hit_fn": [None]})
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "ord"])
        ts, event, fn = rows["ts"].to_numpy("datetime64[us]"), rows["event"].to_numpy(object), rows["fn"].to_numpy(object)
        if opened is not None:  # the open call goes first
            ts, event, fn = np.append(opened, ts), np.append("enter", event), np.append(None, fn)
        enters = event == "enter"
        call = np.cumsum(enters) - 1
        entered, n = ts[enters], int(enters.sum())
        inside = np.flatnonzero((call >= 0) & ~enters)  # what came before the first call counts for none
        late = ts[inside] - entered[call[inside]] > limit
        ends = (event[inside] == "hit") | (event[inside] == "exit") | late
        ended, first = np.unique(call[inside[ends]], return_index=True)  # each call ends at the first of these
        at, in_time = inside[ends][first], ~late[ends][first]
        hit = (event[at] == "hit") & in_time
        hit_at, hit_fn = np.full(n, np.datetime64("NaT", "us")), np.full(n, None, object)
        hit_at[ended[hit]], hit_fn[ended[hit]] = ts[at[hit]], fn[at[hit]]
        still_open = n > 0 and (not len(ended) or ended[-1] != n - 1)
        done = n - still_open
        if still_open:
            last = entered[-1]
            state.update((last.item(),))
            state.setTimeoutTimestamp(max(int(last.astype("datetime64[ms]").astype(int)) + limit_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"tid": [key[0]] * done, "entered": entered[:done], "hit_at": hit_at[:done], "hit_fn": hit_fn[:done]})

    keyed = events.withColumn("tid", F.col("tid").cast("string")).withWatermark("ts", delay)
    return keyed.groupBy("tid").applyInPandasWithState(step, _OUT, _STATE, "append", "EventTimeTimeout")


# Edge states


def mark_stale(edges: DataFrame) -> DataFrame:
    """All edges that were observed become stale; an edge without a state stays without."""
    change = (F.col("resolvedBy") == "dynamic") & (F.col("state") != "stale")
    return edges.withColumn("state", F.when(change, "stale").otherwise(F.col("state")))


def stale(edges: DataFrame, limit: int | None = None) -> DataFrame:
    out = edges.where("resolvedBy = 'dynamic' AND state = 'stale'")
    return out.orderBy("callerFunction", "callExpression", "target").limit(limit) if limit else out


def last_observations(observations: DataFrame) -> DataFrame:
    """caller_fn, call_site and the last function that was hit there."""
    return observations.where("hit_fn IS NOT NULL").groupBy("caller_fn", "call_site").agg(F.max_by("hit_fn", F.struct("ts", "hit_fn")).alias("hit_fn"))


def checkup(edges: DataFrame, observations: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Stale edges against what was observed since: the same or a new target is verified, for `days`; none leaves it stale."""
    seen = last_observations(observations).select(F.col("caller_fn").alias("callerFunction"), F.col("call_site").alias("callExpression"), "hit_fn")
    j = edges.join(seen, ["callerFunction", "callExpression"], "left")
    hit = (F.col("resolvedBy") == "dynamic") & (F.col("state") == "stale") & F.col("hit_fn").isNotNull()
    cols = {"target": F.when(hit, F.col("hit_fn")).otherwise(F.col("target")), "state": F.when(hit, "verified").otherwise(F.col("state")), "validUntil": F.when(hit, valid_until(now, days)).otherwise(F.col("validUntil"))}
    # Two stale edges of one call site that both move to the new target become one.
    return j.select(*(cols.get(c, F.col(c)).alias(c) for c in edges.columns)).dropDuplicates(["callerFunction", "callExpression", "target", "resolvedBy"])


def checkup_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """verified, still_stale."""
    stale_ = F.count_if(F.expr("resolvedBy = 'dynamic' AND state = 'stale'"))
    return one_row(before.agg(stale_.alias("had")), after.agg(stale_.alias("still_stale"))).select((F.col("had") - F.col("still_stale")).alias("verified"), "still_stale")


def record_observations(edges: DataFrame, observations: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Edges with one more for each call site that was observed and has no such edge yet."""
    seen = last_observations(observations).select(F.col("caller_fn").alias("callerFunction"), F.col("call_site").alias("callExpression"), F.col("hit_fn").alias("target"))
    new = seen.join(edges.where("resolvedBy = 'dynamic'").select("callerFunction", "callExpression"), ["callerFunction", "callExpression"], "left_anti")
    made = new.select("*", F.lit("dynamic").alias("resolvedBy"), F.lit("verified").alias("state"), valid_until(now, days).alias("validUntil"))
    return edges.unionByName(made, allowMissingColumns=True)


def expire(edges: DataFrame, now: Column) -> DataFrame:
    """Verified edges past their time become stale."""
    gone = (F.col("resolvedBy") == "dynamic") & (F.col("state") == "verified") & (F.col("validUntil") < now)
    return edges.withColumn("state", F.when(gone, "stale").otherwise(F.col("state")))

"""Argument-sensitive, branch-pruned breadth-first traversal, one level of the graph at a time.

A queue that is read first in, first out takes all of one depth before the next, and the first copy of a name that was
put in is the one that is visited. So a level is a frame (fn, seq, depth, via, env) and the next one follows by joins: seq
is the order of visits. Whether a function was visited when a row of the level looks at it is a matter of order: it is in
an earlier level, or in this one at the same place or before.

Levels are written to the shared folder, so plans don't grow with the depth. Of a level only as many rows are taken, the
first in order, as the path may still have steps, and what needs one order over a level works on those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.dedup import first_wins
from plumbline.operators.graph import CodeGraph, bulk_caller_counts, entry_function
from plumbline.operators.stitch import source_rank
from plumbline.sources.shared import Scratch

ENTRY, DIRECT, CROSS, UNRESOLVED, PRUNED = "syscall entry", "direct call", "direct call [cross-subsystem]", "indirect — no target found", "pruned: branch mismatch"
REASON = "branch condition excluded"
_ENV = "map<string,bigint>"
_SITES = f"fn string, seq bigint, depth int, env {_ENV}, ptr string, callee string, kind string, outcome string"


@dataclass(frozen=True)
class Traversal:
    """path: seq, depth, function, via, resolved; pruned: depth, function, resolved, reason, ord; unresolved, dynamic_hits: expression, ord."""

    path: DataFrame
    pruned: DataFrame
    unresolved: DataFrame
    dynamic_hits: DataFrame


@dataclass(frozen=True)
class _Lookup:
    calls: DataFrame
    sites: DataFrame
    branches: DataFrame
    flows: DataFrame
    by_index: DataFrame
    by_field: DataFrame
    infra: DataFrame
    observed: DataFrame
    has_sites: bool


def call_sites(g: CodeGraph) -> DataFrame:
    """callerFunction, callExpression, target, _index of every indirect call: its resolutions among known functions, else nulls."""
    name = g.functions.select(F.col("name").alias("target"))
    resolved = g.resolves.select("callerFunction", "callExpression", "target", F.col("arrayIndex").alias("_index")).join(name, "target", "left_semi")
    return g.indirect_edges.select(F.col("callerFn").alias("callerFunction"), "callExpression").join(resolved, ["callerFunction", "callExpression"], "left")


def candidates(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """The best assignment of each field and slot (_field, _at, _indexed), and of each field (_field, _any), to known functions."""
    usable = g.fnptrs.join(g.functions.select(F.col("name").alias("targetFn")), "targetFn", "left_semi")
    order = [source_rank(F.col("source")), "ord"]
    by_index = first_wins(usable.where("arrayIndex IS NOT NULL"), ["fieldName", "arrayIndex"], order).select(F.col("fieldName").alias("_field"), F.col("arrayIndex").alias("_at"), F.col("targetFn").alias("_indexed"))
    return by_index, first_wins(usable, ["fieldName"], order).select(F.col("fieldName").alias("_field"), F.col("targetFn").alias("_any"))


def passed_arguments(flows: DataFrame) -> DataFrame:
    """callerFn, callee, flows: which argument of a caller becomes which of a callee, in one array for each pair."""
    each = F.struct(F.col("callerArgPos").alias("from_pos"), F.col("calleeParamPos").alias("to_pos"), F.coalesce("calleeParamName", F.lit("")).alias("param"))
    return flows.groupBy("callerFn", "calleeFn").agg(F.array_sort(F.collect_list(each)).alias("flows"))


def _lookup(g: CodeGraph, scratch: Scratch, infra_threshold: int, observations: DataFrame | None) -> _Lookup:
    keep = scratch.keep
    by_index, by_field = candidates(g)
    seen = observations if observations is not None else g.calls.sparkSession.createDataFrame([], "caller_fn string, call_site string, hit_fn string, ts timestamp")
    # The last hit, of equal times the greatest name, as where observations become edges.
    last = seen.where("hit_fn IS NOT NULL").groupBy(F.col("caller_fn").alias("fn"), F.col("call_site").alias("ptr")).agg(F.max_by("hit_fn", F.struct("ts", "hit_fn")).alias("_observed"))
    all_sites = keep(call_sites(g).select(F.col("callerFunction").alias("fn"), F.col("callExpression").alias("ptr"), "target", "_index"))
    return _Lookup(
        calls=keep(g.calls.select(F.col("callerFn").alias("fn"), F.col("calleeFn").alias("callee"), F.coalesce("crossSubsystem", F.lit(False)).alias("cross"))),
        sites=all_sites,
        has_sites=not all_sites.isEmpty(),
        branches=keep(g.branches.where("conditionRHSLabel <> ''").select(F.col("function").alias("fn"), "conditionOp", "conditionLHS", "conditionRHSValue", "lhsArgPos", F.col("conditionRHSLabel").alias("callee"))),
        flows=keep(passed_arguments(g.flows).select(F.col("callerFn").alias("fn"), F.col("calleeFn").alias("callee"), "flows")),
        by_index=keep(by_index),
        by_field=keep(by_field),
        infra=keep(bulk_caller_counts(g.calls, infra_threshold).select(F.col("name").alias("callee"), F.lit(True).alias("infra"))),
        observed=keep(last),
    )


def traverse(g: CodeGraph, entry: str, env: dict[str, int | None] | None = None, max_depth: int = 30, max_steps: int = 500, infra_threshold: int = 20, observations: DataFrame | None = None, prefer_indexed: bool = False) -> Traversal:
    """Walk from `entry` under the arguments `env`.

    Functions with more than infra_threshold callers are not entered; calls that a branch excludes are pruned; an
    indirect call goes to its static resolution, else to the assignment of its field (and slot), else to what was
    observed, else it is unresolved. With prefer_indexed the slot goes before a static resolution without one. Of a
    function's calls direct ones come first, by callee, then indirect ones, by expression.
    """
    spark = g.calls.sparkSession
    scratch = Scratch(spark, "traverse")
    t = _lookup(g, scratch, infra_threshold, observations)
    start = spark.createDataFrame([(entry, 0, 0, ENTRY, env or {})], f"fn string, seq long, depth int, via string, env {_ENV}")
    front, seen = scratch.keep(start), None
    steps, pruned, lost, hits = [], [], [], []
    length = 0
    for depth in range(max_depth + 1):
        here = front.select("fn", F.col("seq").alias("_seen"))
        visited = here if seen is None else seen.unionByName(here)
        v = visited.select(F.col("fn").alias("callee"), "_seen")
        direct = _direct(front, t, v)
        sites = scratch.keep(_indirect(front, t, v, prefer_indexed)) if t.has_sites else spark.createDataFrame([], _SITES)
        n_lost = sites.where("outcome = 'unresolved'").groupBy("seq").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum(1 + F.coalesce("n", F.lit(0))).over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = front.join(n_lost, "seq", "left").withColumn("_length", F.lit(length) + before)
        cut = counted.agg(F.count_if(F.col("_length") >= max_steps), F.max(F.when(F.col("_length") < max_steps, F.col("_length") + 1 + F.coalesce("n", F.lit(0)))), F.max(F.when(F.col("_length") < max_steps, F.col("seq")))).first()
        if cut[1] is None:
            break
        length, last = cut[1], cut[2]
        direct, sites = scratch.keep(direct.where(F.col("seq") <= last)), sites.where(F.col("seq") <= last)
        steps.append(front.where(F.col("seq") <= last).select("seq", F.lit("").alias("sub"), "depth", F.col("fn").alias("function"), "via", F.col("env").alias("resolved")))
        gone = sites.where("outcome = 'unresolved'")
        steps.append(gone.select("seq", F.concat(F.lit("~"), "ptr").alias("sub"), (F.col("depth") + 1).alias("depth"), F.concat(F.lit("[UNRESOLVED] "), "ptr").alias("function"), F.lit(UNRESOLVED).alias("via"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")).alias("resolved")))
        pruned.append(direct.where("outcome = 'pruned'").select("seq", "depth", F.col("callee").alias("function"), F.col("env").alias("resolved")))
        lost.append(gone.select("seq", F.col("ptr").alias("expression")))
        hits.append(sites.where("kind = 'dynamic'").select("seq", F.col("ptr").alias("expression")))
        if cut[0] or depth == max_depth or length >= max_steps:
            break
        order = ["p_seq", "k", "sub"]
        nxt = _next(direct, sites, visited, t).orderBy(*order).limit(max_steps - length)  # no more can become steps
        front = scratch.keep(nxt.select("fn", (F.lit(last).cast("long") + F.row_number().over(Window.orderBy(*order))).alias("seq"), F.lit(depth + 1).alias("depth"), "via", "env"))
        seen = visited  # a union of written levels
        if front.isEmpty():
            break
    path = _union(steps).withColumn("seq", F.row_number().over(Window.orderBy("seq", "sub")) - 1)  # some max_steps rows
    once = lambda frames: _union(frames).groupBy("expression").agg(F.min("seq").alias("seq"))
    cuts = _ranked(_union(pruned), "function")
    return Traversal(
        path=path.select("seq", "depth", "function", "via", "resolved"),
        pruned=cuts.select("ord", (F.col("depth") + 1).alias("depth"), "function", "resolved", F.lit(REASON).alias("reason")),
        unresolved=_ranked(once(lost), "expression").select("expression", "ord"),
        dynamic_hits=_ranked(_union(hits), "expression").select("expression", "ord"),
    )


def _ranked(rows: DataFrame, by: str) -> DataFrame:
    """ord: the step's place in the high bits, then the place among the step's rows, so that no order is needed over all."""
    return rows.withColumn("ord", F.shiftleft("seq", 32) + F.row_number().over(Window.partitionBy("seq").orderBy(by)))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _open(place: Column) -> Column:
    """Not visited when the row at seq looked."""
    return place.isNull() | (place > F.col("seq"))


def _direct(front: DataFrame, t: _Lookup, v: DataFrame) -> DataFrame:
    """Direct calls of the level that are neither visited nor infrastructure: outcome "call" or "pruned"."""
    holds = S.branch_holds(F.col("conditionOp"), F.col("conditionLHS"), F.col("conditionRHSValue"), F.col("lhsArgPos"), F.col("env"))
    excluded = front.join(t.branches, "fn").where(~F.coalesce(holds, F.lit(True))).select("seq", "callee", F.lit(True).alias("excluded")).distinct()
    out = front.join(t.calls, "fn").join(t.infra, "callee", "left").join(v, "callee", "left").where(F.col("infra").isNull() & _open(F.col("_seen")))
    out = out.join(excluded, ["seq", "callee"], "left")
    return out.select("fn", "seq", "depth", "env", "callee", "cross", F.when(F.col("excluded"), "pruned").otherwise("call").alias("outcome"))


def _indirect(front: DataFrame, t: _Lookup, v: DataFrame, prefer_indexed: bool) -> DataFrame:
    """Indirect calls of the level: outcome "call" (to callee, by kind), "dropped" or "unresolved"."""
    x = front.join(t.sites, "fn")
    infra = t.infra.select(F.col("callee").alias("target"), F.col("infra").alias("_infra"))
    of = lambda name, seen: v.select(F.col("callee").alias(name), F.col("_seen").alias(seen))
    x = x.join(infra, "target", "left").join(of("target", "_t"), "target", "left")
    static = F.col("target").isNotNull() & F.col("_infra").isNull() & _open(F.col("_t"))
    x = x.withColumn("_field", S.field_name(F.col("ptr"))).withColumn("_at", S.match_index(F.col("ptr"), F.col("env"), F.col("_index")))
    x = x.join(t.by_index, ["_field", "_at"], "left").join(t.by_field, "_field", "left")
    x = x.withColumn("_cand", F.when(F.col("_at").isNotNull(), F.col("_indexed")).otherwise(F.col("_any")))
    x = x.join(of("_cand", "_c"), "_cand", "left").join(t.observed, ["fn", "ptr"], "left").join(of("_observed", "_o"), "_observed", "left")
    if prefer_indexed:
        static = static & (F.col("_at").isNull() | F.col("_indexed").isNull())
    fresh = F.col("_observed").isNotNull() & _open(F.col("_o"))
    kind = F.when(static, "static_fnptr").when(F.col("_cand").isNotNull(), "graph").when(fresh, "dynamic")
    callee = F.when(kind == "static_fnptr", F.col("target")).when(kind == "graph", F.col("_cand")).when(kind == "dynamic", F.col("_observed"))
    outcome = F.when(kind.isNull(), "unresolved").when((kind == "graph") & ~_open(F.col("_c")), "dropped").otherwise("call")
    return x.select("fn", "seq", "depth", "env", "ptr", callee.alias("callee"), kind.alias("kind"), outcome.alias("outcome"))


def _next(direct: DataFrame, sites: DataFrame, visited: DataFrame, t: _Lookup) -> DataFrame:
    """The calls that open the next level: of each function the first, with its arguments."""
    d = direct.where("outcome = 'call'").select(F.col("callee").alias("to"), F.col("seq").alias("p_seq"), F.lit(0).alias("k"), F.col("callee").alias("sub"), F.when(F.col("cross"), CROSS).otherwise(DIRECT).alias("via"), "fn", "env")
    i = sites.where("outcome = 'call'").select(F.col("callee").alias("to"), F.col("seq").alias("p_seq"), F.lit(1).alias("k"), F.concat_ws("\u0001", "ptr", "callee").alias("sub"), F.concat(F.lit("fn_ptr: "), "ptr", F.lit(" ["), "kind", F.lit("]")).alias("via"), "fn", "env")
    new = d.unionByName(i).join(visited.select(F.col("fn").alias("to")), "to", "left_anti")
    one = first_wins(new, ["to"], ["p_seq", "k", "sub"])
    flows = t.flows.select("fn", F.col("callee").alias("to"), "flows")
    none = F.array().cast("array<struct<from_pos:int,to_pos:int,param:string>>")
    env = S.propagate(F.col("env"), F.coalesce("flows", none))
    # Arguments after the choice: only the copies that are visited need them.
    return one.join(flows, ["fn", "to"], "left").select(F.col("to").alias("fn"), "p_seq", "k", "sub", "via", env.alias("env"))


def bind(spark: SparkSession, constants: DataFrame, expr: str) -> tuple[str, list[str], dict[str, int | None]]:
    """Name, arguments and their values of a call, with the constants it names."""
    call = spark.range(1).select(S.parse_call(F.lit(expr)).alias("c")).first().c
    if call is None:
        raise ValueError(f"no call: {expr!r}")
    known = constants.where(F.col("name").isin(list(call.args)) & F.col("value").isNotNull()).select("name", "value").distinct().collect() if call.args else []
    table = F.create_map(*(x for r in known for x in (F.lit(r.name), F.lit(r.value).cast("bigint")))) if known else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    args = F.array(*(F.lit(a) for a in call.args)).cast("array<string>")
    return call.name, list(call.args), spark.range(1).select(S.resolve_args(args, table).alias("env")).first().env


@dataclass(frozen=True)
class Prediction:
    call: str
    args: list[str]
    env: dict[str, int | None]
    entry: str
    walk: Traversal


def predict(g: CodeGraph, expr: str, **how) -> Prediction:
    """The path of a call such as `socket(AF_INET, SOCK_STREAM, 0)`."""
    call, args, env = bind(g.calls.sparkSession, g.constants, expr)
    entry = entry_function(g.functions, call)
    if entry is None:
        raise LookupError(f"no entry function for {call}")
    scratch = Scratch(g.calls.sparkSession, "predict")
    walk = traverse(g, entry, env, **how)
    return Prediction(call, args, env, entry, Traversal(*(scratch.keep(df) for df in (walk.path, walk.pruned, walk.unresolved, walk.dynamic_hits))))


def reach(edges: DataFrame, start: DataFrame, max_depth: int = 100, blocked: DataFrame | None = None) -> DataFrame:
    """node, depth of what is reachable from `start` (node) along edges (src, dst), by least depth; blocked nodes are not entered."""
    scratch = Scratch(edges.sparkSession, "reach")
    links = scratch.keep((edges if blocked is None else edges.join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")).select("src", "dst").distinct())
    front = scratch.keep(start.select("node", F.lit(0).alias("depth")).distinct())
    out = front
    for depth in range(1, max_depth + 1):
        new = front.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct().join(out.select("node"), "node", "left_anti")
        front = scratch.keep(new)
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out

"""Enrichment passes: each takes the graph and returns it changed, with the counts it made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.graph import CodeGraph

Pass = Callable[[CodeGraph], CodeGraph]


def source_rank(source: Column) -> Column:
    return F.when(source == "gcc", 0).when(source == "joern", 1).otherwise(2)


# Stubs


def stub_map(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """stub, real (ids) of functions that have one name, one external and one not. rows: id, name, isExternal."""
    by = rows.groupBy("name").agg(F.min(F.when(~F.col("isExternal"), F.col("id"))).alias("real"))
    found = rows.where("isExternal").join(by.where("real IS NOT NULL"), "name").select(F.col("id").alias("stub"), "real").where("stub <> real")
    return found.orderBy("stub").limit(limit) if limit else found


def redirect(edges: DataFrame, stubs: DataFrame, *ends: str) -> DataFrame:
    """Edges at a stub go to the real function; edges that then are equal become one."""
    for e in ends:
        m = stubs.select(F.col("stub").alias(e), "real")
        edges = edges.join(m, e, "left").withColumn(e, F.coalesce("real", e)).drop("real")
    return edges.dropDuplicates()


def drop_unlinked_stubs(rows: DataFrame, stubs: DataFrame, *edges: DataFrame) -> DataFrame:
    """Functions without the stubs that no edge (src, dst) touches."""
    touched = None
    for e in edges:
        ids = e.select(F.explode(F.array("src", "dst")).alias("id"))
        touched = ids if touched is None else touched.unionByName(ids)
    gone = stubs.select(F.col("stub").alias("id")).join(touched, "id", "left_anti")
    return rows.join(gone, "id", "left_anti")


def merge_stubs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge records without the stubs whose function is known under the same name.

    It goes before the load, where names become unique. Records refer to functions by name, so edges need no change but
    for those that repeat: a stub's record goes, and with it what it would have filled in.
    """
    fns = nodes.where("nodeType = 'Function'")
    real = fns.where("NOT coalesce(isExternal, false)").select("name").distinct().withColumn("_real", F.lit(True))
    marked = nodes.join(real, "name", "left")
    stub = (F.col("nodeType") == "Function") & F.coalesce("isExternal", F.lit(False)) & F.col("_real").isNotNull()
    return marked.where(~F.coalesce(stub, F.lit(False))).select(*nodes.columns), edges


# Subsystems


def _sub(functions: DataFrame, end: str, to: str) -> DataFrame:
    return functions.select(F.col("name").alias(end), F.when(F.col("subsystem") != "", F.col("subsystem")).alias(to))


def tag_crossing(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """crossSubsystem on edges whose ends' subsystems are known and differ; others stay as they are."""
    both = edges.join(_sub(functions, "callerFn", "_a"), "callerFn", "left").join(_sub(functions, "calleeFn", "_b"), "calleeFn", "left")
    return both.withColumn("crossSubsystem", F.when(F.col("_a") != F.col("_b"), F.lit(True)).otherwise(F.col("crossSubsystem"))).drop("_a", "_b").select(*edges.columns)


def crossings(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """src, dst: which subsystem calls into which, by tagged edges."""
    ends = edges.where("crossSubsystem").join(_sub(functions, "callerFn", "src"), "callerFn").join(_sub(functions, "calleeFn", "dst"), "calleeFn")
    return ends.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def tag_calls(g: CodeGraph) -> CodeGraph:
    return g.with_(calls=tag_crossing(g.calls, g.functions))


def tag_flows(g: CodeGraph) -> CodeGraph:
    return g.with_(flows=tag_crossing(g.flows, g.functions))


def roll_up(g: CodeGraph) -> CodeGraph:
    """Subsystems, and which calls into which."""
    names = g.functions.select(F.col("subsystem").alias("name")).where("name IS NOT NULL AND name <> ''").distinct()
    return g.with_(subsystems=names, calls_into=crossings(g.calls, g.functions))


# Indirect calls


def resolutions(sites: DataFrame, pointers: DataFrame, known_structs: Column | None = None, targets: DataFrame | None = None) -> DataFrame:
    """callerFunction, callExpression, target, resolvedBy, arrayIndex of every call site that has an assignment.

    A site's field is looked up among assignments. First come those of the inferred struct, then those of a literal
    slot, then any; in each the compiler's before others', and of equals the one with the smallest ord. A target that is
    no function of `targets` (name) is none.
    """
    p = pointers if targets is None else pointers.join(targets.select(F.col("name").alias("targetFn")), "targetFn", "left_semi")
    p = p.select(F.col("fieldName").alias("_field"), F.col("structType").alias("_struct"), F.col("arrayIndex").alias("_index"), F.struct("targetFn", "arrayIndex").alias("hit"), source_rank(F.col("source")).alias("rank"), F.col("ord").alias("_ord"))
    expr = F.col("callExpression")
    out = sites.select("callerFunction", "callExpression", S.field_name(expr).alias("_field"), S.literal_index(expr).alias("_index"), S.struct_type(expr, known_structs).alias("_struct")).distinct()
    # One row for each struct's field, for each slot and for each field: a site meets three rows at most, however many
    # assignments its field has.
    for name, key in (("typed", ["_field", "_struct"]), ("indexed", ["_field", "_index"]), ("fallback", ["_field"])):
        best = p.where(F.col(key[-1]).isNotNull()).groupBy(*key).agg(F.min_by("hit", F.struct("rank", "_ord")).alias(name))
        out = out.join(best, key, "left")
    by = F.when(F.col("typed").isNotNull(), "static_fnptr_typed").when(F.col("indexed").isNotNull(), "static_fnptr_indexed").otherwise("static_fnptr_fallback")
    found = out.withColumn("hit", F.coalesce("typed", "indexed", "fallback")).where("hit IS NOT NULL")
    return found.select("callerFunction", "callExpression", F.col("hit.targetFn").alias("target"), by.alias("resolvedBy"), F.col("hit.arrayIndex").alias("arrayIndex"))


def resolve_indirect(g: CodeGraph, known_structs: Column | None = None) -> CodeGraph:
    """Static resolutions anew; what was observed at run time stays."""
    found = resolutions(g.indirect_calls, g.fnptrs, known_structs, g.functions)
    kept = g.resolves.where("resolvedBy = 'dynamic'")
    static = found.select("*", F.lit(None).cast("string").alias("state"), F.lit(None).cast("bigint").alias("validUntil"))
    done = found.select("callerFunction", "callExpression", F.lit(True).alias("_done"))
    sites = g.indirect_calls.drop("state").join(done, ["callerFunction", "callExpression"], "left")
    sites = sites.withColumn("state", F.when(F.col("_done"), "resolved_static").otherwise("unresolved")).drop("_done")
    return g.with_(resolves=static.unionByName(kept), indirect_calls=sites)


# Orphans and health


def orphan_flags(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """orphan on functions that are not external and have no call in or out."""
    linked = calls.select(F.explode(F.array("callerFn", "calleeFn")).alias("name")).distinct().withColumn("_linked", F.lit(True))
    return functions.drop("orphan").join(linked, "name", "left").withColumn("orphan", F.col("_linked").isNull() & ~F.col("isExternal")).drop("_linked")


def tag_orphans(g: CodeGraph) -> CodeGraph:
    return g.with_(functions=orphan_flags(g.functions, g.calls))


PASSES: list[tuple[str, Pass]] = [
    ("tag_calls", tag_calls),
    ("resolve_indirect", resolve_indirect),
    ("tag_flows", tag_flows),
    ("roll_up", roll_up),
    ("tag_orphans", tag_orphans),
]


def stitch(g: CodeGraph, passes: int | None = None) -> CodeGraph:
    """The first `passes` passes, all if not given. Nothing is written, so this is also the dry run."""
    for _, f in PASSES[:passes]:
        g = f(g)
    return g

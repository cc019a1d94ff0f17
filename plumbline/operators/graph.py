"""The property graph as tables: a frame for each kind of node and edge, keyed by names."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import scalars as S
from plumbline.operators.dedup import fill, filled, latest, sticky, upsert


@dataclass(frozen=True)
class CodeGraph:
    functions: DataFrame
    parameters: DataFrame
    branches: DataFrame
    constants: DataFrame
    indirect_calls: DataFrame
    fnptrs: DataFrame
    calls: DataFrame
    flows: DataFrame
    indirect_edges: DataFrame
    assigns: DataFrame
    resolves: DataFrame
    subsystems: DataFrame | None = None
    calls_into: DataFrame | None = None

    def with_(self, **frames: DataFrame) -> CodeGraph:
        return replace(self, **frames)

    def frames(self) -> dict[str, DataFrame]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    def save(self, path: str) -> None:
        """Write all tables; each replaces what was there."""
        for name, df in self.frames().items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    def views(self) -> None:
        """Register every table, and edges of containment, as a view for SQL."""
        for name, df in self.frames().items():
            df.createOrReplaceTempView(name)
        has_branch(self).createOrReplaceTempView("has_branch")
        has_parameter(self).createOrReplaceTempView("has_parameter")


def read_graph(spark: SparkSession, path: str) -> CodeGraph:
    from plumbline.sources.records import has_success

    names = [f.name for f in fields(CodeGraph)]
    return CodeGraph(**{n: spark.read.parquet(f"{path}/{n}") for n in names if n not in ("subsystems", "calls_into") or has_success(spark, f"{path}/{n}")})


def _columns(df: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """The columns of `schema` and ord: what is lacking is null, what has a default is never null."""
    from pyspark.sql.types import StructType

    own, d = set(df.columns), defaults or {}
    cols = []
    for f in StructType.fromDDL(schema).fields:
        c = (F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType)
        cols.append((F.coalesce(c, F.lit(d[f.name]).cast(f.dataType)) if f.name in d else c).alias(f.name))
    return df.select(*cols, "ord")


def _named(df: DataFrame, *names: str) -> DataFrame:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).isNotNull() & (F.col(n) != "")
    return df.where(cond)


# Nodes


def functions(nodes: DataFrame, root: str = "", depth: int = 1) -> DataFrame:
    """One function a name. Paths, ids and lines are filled from later rows; what else differs stays as it came first.

    An empty subsystem is null; where it is null it follows from the file.
    """
    rows = _named(_columns(nodes.withColumn("gid", F.col("gid") if "gid" in nodes.columns else F.lit(None).cast("long")), schemas.FUNCTION + ", gid bigint", {"fullName": "", "file": "", "line": -1, "signature": "", "isExternal": False, "subsystem": ""}), "name")
    spec = {"fullName": fill(filled("fullName", "")), "file": fill(filled("file", "")), "line": fill(filled("line", -1)), "gid": fill(F.col("gid").isNotNull())}
    path = F.coalesce(S.make_relative(F.col("file"), root), F.col("file")) if root else F.col("file")
    derived = F.coalesce(F.when(F.col("subsystem") != "", F.col("subsystem")), S.subsystem_key(path, depth))
    return upsert(rows, ["name"], spec).withColumn("subsystem", derived)


def parameters(nodes: DataFrame) -> DataFrame:
    rows = _columns(nodes, schemas.PARAMETER, {"name": "", "position": -1, "typeFullName": ""})
    return upsert(_named(rows, "functionName"), ["functionName", "position"], {})


def branches(nodes: DataFrame, key: str = "short") -> DataFrame:
    """Branches found in source go before the compiler's. Key: function, left side, comparison; "full" adds the value.

    With the short key a row may pair the first value with the last label of tests that differ in their value.
    """
    compiler = F.col("nodeType") == "BranchCondition"
    # A compiler's branch is taken into the shape of one found in source, its value written as text.
    text = F.when(compiler, F.col("conditionRHSValue").cast("string")).otherwise(F.col("conditionRHS"))
    kind = F.when(compiler, F.coalesce("branchType", F.lit("if"))).otherwise(F.col("branchType"))
    shaped = nodes.withColumns({"conditionRHS": text, "branchType": kind, "_class": compiler.cast("int")})
    shaped = shaped.withColumn("ord", F.shiftleft(F.col("_class").cast("long"), 62) + F.col("ord"))
    rows = _named(_columns(shaped, schemas.BRANCH_POINT, {"conditionLHS": "", "conditionOp": "", "lhsArgPos": -1}), "function")
    keys = ["function", "conditionLHS", "conditionOp", *(["conditionRHSValue"] if key == "full" else [])]
    return upsert(rows, keys, {"source": sticky("gcc"), "conditionRHSLabel": latest(F.col("conditionRHSLabel").isNotNull()), "lhsArgPos": latest(F.col("lhsArgPos") >= 0)})


def constants(rows: DataFrame) -> DataFrame:
    """A value beyond 64 bits is null."""
    return upsert(_named(rows.select("name", F.col("value").cast("string").try_cast("bigint").alias("value"), "source", "ord"), "name"), ["name"], {})


def indirect_calls(nodes: DataFrame) -> DataFrame:
    rows = _named(_columns(nodes, schemas.INDIRECT_CALL, {"file": "", "line": -1}), "callerFunction", "callExpression")
    return upsert(rows, ["callerFunction", "callExpression"], {}).withColumn("state", F.lit("unresolved"))


def fnptrs(nodes: DataFrame, key: str = "short") -> DataFrame:
    """Assignments by field and target; "full" adds the slot, which else is the last one given."""
    rows = _columns(nodes, schemas.FNPTR_ASSIGNMENT, {"fieldName": "", "sourceFile": "", "line": -1})
    keys = ["fieldName", "targetFn", *(["arrayIndex"] if key == "full" else [])]
    return upsert(_named(rows, "targetFn"), keys, {"source": sticky("gcc"), "arrayIndex": latest(F.col("arrayIndex").isNotNull())})


# Edges


def with_ends(edges: DataFrame, functions_: DataFrame, *ends: str) -> DataFrame:
    """Edges whose ends are functions of the graph; the others vanish."""
    names = functions_.select("name")
    for e in ends:
        edges = edges.join(names.withColumnRenamed("name", e), e, "left_semi")
    return edges


def calls(edges: DataFrame, functions_: DataFrame) -> DataFrame:
    rows = _named(_columns(edges, schemas.CALL_EDGE, {"file": "", "line": -1}), "callerFn", "calleeFn").withColumnRenamed("source", "resolvedBy")
    merged = upsert(rows, ["callerFn", "calleeFn"], {"resolvedBy": sticky("gcc"), "line": fill(filled("line", -1))})
    return with_ends(merged, functions_, "callerFn", "calleeFn").withColumn("crossSubsystem", F.lit(None).cast("boolean"))


def flows(edges: DataFrame, functions_: DataFrame) -> DataFrame:
    rows = _named(_columns(edges, schemas.DATAFLOW_EDGE, {"callerArgPos": -1, "calleeParamPos": -1, "callerArgCode": "", "calleeParamName": ""}), "callerFn", "calleeFn")
    merged = upsert(rows, ["callerFn", "calleeFn", "callerArgPos", "calleeParamPos"], {})
    return with_ends(merged, functions_, "callerFn", "calleeFn").withColumn("crossSubsystem", F.lit(None).cast("boolean"))


def indirect_edges(edges: DataFrame, functions_: DataFrame, sites: DataFrame) -> DataFrame:
    """Function -> indirect call, by the call's two-part key."""
    rows = _named(_columns(edges, schemas.INDIRECT_CALL_EDGE, {"file": "", "line": -1, "argCount": 0}), "callerFn", "callExpression")
    known = sites.select(F.col("callerFunction").alias("callerFn"), "callExpression")
    return with_ends(upsert(rows, ["callerFn", "callExpression"], {}), functions_, "callerFn").join(known, ["callerFn", "callExpression"], "left_semi")


def assigns(pointers: DataFrame, functions_: DataFrame) -> DataFrame:
    """Assignment -> the function it assigns."""
    named = pointers.select("fieldName", "targetFn", F.col("source").alias("resolvedBy"), "arrayIndex", "ord")
    return with_ends(named, functions_, "targetFn")


def has_branch(g: CodeGraph) -> DataFrame:
    return with_ends(g.branches.select("function", "conditionLHS", "conditionOp", "conditionRHSValue"), g.functions, "function")


def has_parameter(g: CodeGraph) -> DataFrame:
    return with_ends(g.parameters.select("functionName", "position"), g.functions, "functionName")


def load(nodes: DataFrame, edges: DataFrame, constant_rows: DataFrame, root: str = "", depth: int = 1, branch_key: str = "short", fnptr_key: str = "short") -> CodeGraph:
    """The graph of node records (nodeType), edge records (edgeType) and constants, all with ord."""
    of = lambda df, kind, *names: df.where(F.col(kind).isin(*names))
    fns = functions(of(nodes, "nodeType", "Function"), root, depth)
    sites = indirect_calls(of(nodes, "nodeType", "IndirectCall"))
    pointers = fnptrs(of(nodes, "nodeType", "FnPtrAssignment"), fnptr_key)
    return CodeGraph(
        functions=fns,
        parameters=parameters(of(nodes, "nodeType", "Parameter")),
        branches=branches(of(nodes, "nodeType", "BranchPoint", "BranchCondition"), branch_key),
        constants=constants(constant_rows),
        indirect_calls=sites,
        fnptrs=pointers,
        calls=calls(of(edges, "edgeType", "CallEdge"), fns),
        flows=flows(of(edges, "edgeType", "DataFlowEdge"), fns),
        indirect_edges=indirect_edges(of(edges, "edgeType", "IndirectCallEdge"), fns, sites),
        assigns=assigns(pointers, fns),
        resolves=nodes.sparkSession.createDataFrame([], schemas.RESOLVES_TO),
    )


#: What identifies the rows of each table.
KEYS = {
    "functions": ("name",),
    "parameters": ("functionName", "position"),
    "constants": ("name",),
    "indirect_calls": ("callerFunction", "callExpression"),
    "calls": ("callerFn", "calleeFn"),
    "flows": ("callerFn", "calleeFn", "callerArgPos", "calleeParamPos"),
    "indirect_edges": ("callerFn", "callExpression"),
}


def check_unique(df: DataFrame, *key: str) -> bool:
    """Whether a key identifies rows."""
    return df.groupBy(*key).count().where("count > 1").isEmpty()


def broken_keys(g: CodeGraph) -> list[str]:
    """Tables whose key doesn't identify their rows."""
    found = None
    for name, key in KEYS.items():
        one = getattr(g, name).groupBy(*key).count().where("count > 1").select(F.lit(name).alias("name")).limit(1)
        found = one if found is None else found.unionByName(one)
    broken = {r.name for r in found.collect()}
    return [name for name in KEYS if name in broken]


def bulk_caller_counts(calls_: DataFrame, threshold: int = 20) -> DataFrame:
    """Functions with more than `threshold` distinct callers."""
    distinct = calls_.select("calleeFn", "callerFn").distinct()
    return distinct.groupBy("calleeFn").agg(F.count("*").alias("n")).where(F.col("n") > threshold).select(F.col("calleeFn").alias("name"), "n")


def first_existing(calls_: DataFrame, functions_: DataFrame) -> DataFrame:
    """call, name: the best name under which each call's (call) entry is known."""
    ranked = calls_.select("call", F.posexplode(S.entry_candidates(F.col("call"))).alias("rank", "name"))
    return ranked.join(functions_.select("name"), "name").groupBy("call").agg(F.min_by("name", "rank").alias("name"))


def entry_function(functions_: DataFrame, call: str) -> str | None:
    """The name under which a call's entry is known, the best first."""
    found = first_existing(functions_.sparkSession.createDataFrame([(call,)], "call string"), functions_).first()
    return found and found.name


"""From raw records to clean ones: extraction rules, validation, deduplication, conversion, stubs, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import scalars as S
from plumbline.operators.dedup import first_wins, trusted_first

# Rules that make records of a parsed program's tables


def branch_points(ifs: DataFrame) -> DataFrame:
    """function, code -> BranchPoint: the first comparison; without one only the raw condition."""
    c = S.condition(F.col("code"))
    return ifs.select(
        F.lit("if").alias("branchType"), "function", c["op"].alias("conditionOp"), c["lhs"].alias("conditionLHS"), c["rhs"].alias("conditionRHS"), F.lit(None).cast("bigint").alias("conditionRHSValue"),
        F.when(c.isNull(), F.col("code")).alias("rawCondition"), F.lit("joern").alias("source"), "ord",
    )


def functions(methods: DataFrame) -> DataFrame:
    """name, fullName, file, line, signature, isExternal of parsed methods -> Function; what is lacking is empty or -1."""
    none = F.lit("")
    return methods.select(
        F.lit("Function").alias("nodeType"), "name", F.coalesce("fullName", none).alias("fullName"), F.coalesce("file", none).alias("file"), F.coalesce("line", F.lit(-1)).alias("line"),
        F.coalesce("signature", none).alias("signature"), F.coalesce("isExternal", F.lit(False)).alias("isExternal"), F.lit("joern").alias("source"), "ord",
    )


def parameters(methods: DataFrame) -> DataFrame:
    """name, params (array of name, type in order) -> Parameter with positions from 0."""
    return methods.select("name", F.posexplode("params").alias("position", "p"), "ord").select(F.col("name").alias("functionName"), F.col("p.name").alias("name"), "position", F.col("p.type").alias("typeFullName"), "ord")


def is_indirect() -> Column:
    return (F.size(F.coalesce("callees", F.array())) == 0) | (F.col("methodFullName") == "<operator>.indirectCall")


def call_edges(calls: DataFrame) -> DataFrame:
    """caller, callees, file, line -> CallEdge for each callee that is no operator and no builtin."""
    each = calls.select(F.col("caller").alias("callerFn"), F.explode("callees").alias("calleeFn"), "file", "line", "ord")
    return each.where(~F.col("calleeFn").startswith("<operator>") & ~F.col("calleeFn").startswith("__builtin_")).withColumn("source", F.lit("joern"))


def indirect_calls(calls: DataFrame) -> DataFrame:
    """caller, code, file, line, callees, methodFullName -> IndirectCall of every call through a pointer."""
    return calls.where(is_indirect()).select(F.lit("IndirectCall").alias("nodeType"), F.col("caller").alias("callerFunction"), F.col("code").alias("callExpression"), "file", "line", "ord")


def indirect_call_edges(calls: DataFrame) -> DataFrame:
    """caller, code, file, line, callees, methodFullName, args (array of ord, code) -> IndirectCallEdge."""
    codes = F.transform(F.array_sort("args"), lambda a: a["code"])
    return calls.where(is_indirect()).select(F.col("caller").alias("callerFn"), F.col("code").alias("callExpression"), "file", "line", F.size("args").alias("argCount"), codes.alias("argCodes"), "ord")


def dataflow_edges(calls: DataFrame, params: DataFrame) -> DataFrame:
    """Arguments of calls ⋈ parameters of their callees on the position."""
    args = calls.select(F.col("caller").alias("callerFn"), F.explode("callees").alias("calleeFn"), "args", "ord").select("callerFn", "calleeFn", F.posexplode(F.transform(F.array_sort("args"), lambda a: a["code"])).alias("callerArgPos", "callerArgCode"), "ord")
    p = params.select(F.col("functionName").alias("calleeFn"), F.col("position").alias("callerArgPos"), F.col("name").alias("calleeParamName"))
    return args.join(p, ["calleeFn", "callerArgPos"]).withColumn("calleeParamPos", F.col("callerArgPos"))


def fnptr_assignments(assigns: DataFrame) -> DataFrame:
    """target, value, file, line -> FnPtrAssignment where `&fn` is assigned to `x.field` or `table[n]`; `->` doesn't match."""
    t = F.col("target")
    field = F.coalesce(S.group(t, r"(\w+)\.(\w+)", 2), S.group(t, r"(\w+)\[(\d+)\]", 1))
    index = F.when(~t.rlike(r"(\w+)\.(\w+)"), S.group(t, r"(\w+)\[(\d+)\]", 2).try_cast("bigint"))
    out = assigns.select(F.lit(None).cast("string").alias("structType"), field.alias("fieldName"), S.group(F.col("value"), r"&(\w+)").alias("targetFn"), F.col("file").alias("sourceFile"), "line", index.alias("arrayIndex"), F.lit("joern").alias("source"), "ord")
    return out.where("fieldName IS NOT NULL AND targetFn IS NOT NULL")


def compiler_branches(tests: DataFrame) -> DataFrame:
    """lhs, op, rhs with a literal on either side -> the literal on the right, the comparison turned if it was on the left."""
    left, right = S.int_literal(F.col("lhs")), S.int_literal(F.col("rhs"))
    turned = right.isNull() & left.isNotNull()
    return tests.where(left.isNotNull() | right.isNotNull()).select(
        "function", F.when(turned, F.col("rhs")).otherwise(F.col("lhs")).alias("conditionLHS"), F.when(turned, S.flip_op(F.col("op"))).otherwise(F.col("op")).alias("conditionOp"), F.coalesce(right, left).alias("conditionRHSValue"), "ord"
    )


def switch_branches(cases: DataFrame) -> DataFrame:
    """function, lhs, low, high -> one equality for the low end of a case and one for the high end, nothing in between."""
    ends = F.array_distinct(F.array_compact(F.array("low", "high")))
    return cases.select("function", F.col("lhs").alias("conditionLHS"), F.lit("==").alias("conditionOp"), F.explode(ends).alias("conditionRHSValue"), "ord")


def described_call(var: Column, obj: Column, field: Column, deref: Column) -> Column:
    """How a call through a pointer is written: by field, by dereferenced variable, or unknown."""
    return F.when(field.isNotNull(), F.concat(F.coalesce(obj, F.lit("")), F.lit("->"), field, F.lit("()"))).when(deref & var.isNotNull(), F.concat(F.lit("(*"), var, F.lit(")()"))).otherwise("<indirect_call>")


def compiler_calls(calls: DataFrame) -> DataFrame:
    """callerFn, calleeFn or var, obj, field, deref, and file, line, argCount -> CallEdge, or IndirectCall as it is written."""
    direct = F.col("calleeFn").isNotNull()
    written = described_call(F.col("var"), F.col("obj"), F.col("field"), F.coalesce("deref", F.lit(False)))
    return calls.select(
        F.when(direct, "CallEdge").otherwise("IndirectCall").alias("type"), "callerFn", "calleeFn", F.when(~direct, written).alias("callExpr"), "file", "line", F.when(~direct, F.col("argCount")).alias("argCount"), "ord"
    )


def runtime_assignments(assigns: DataFrame) -> DataFrame:
    """place ("field", "slot", "variable", "deref"), base, member, slot, targetFn, file, line -> FnPtrAssignment.

    A field goes by its struct and name, a slot by its array, whose field is `[]`, and number; a variable by its own
    name, what a pointer points to by the pointer's with a star. Without a known function there is no assignment.
    """
    place = F.col("place")
    field = F.when(place == "field", F.col("member")).when(place == "slot", "[]").when(place == "variable", F.col("base")).when(place == "deref", F.concat(F.lit("*"), "base"))
    made = assigns.select(
        F.lit("FnPtrAssignment").alias("type"), F.when(place.isin("field", "slot"), F.col("base")).alias("structType"), field.alias("fieldName"), "targetFn", F.col("file").alias("sourceFile"), "line",
        F.when(place == "slot", F.col("slot")).alias("arrayIndex"), F.lit("runtime_assign").alias("context"), "ord",
    )
    return made.where("fieldName IS NOT NULL AND targetFn IS NOT NULL")


def argument_assignments(calls: DataFrame) -> DataFrame:
    """Functions passed as arguments -> FnPtrAssignment with field arg<i>."""
    each = calls.select("calleeFn", "file", "line", F.posexplode("args").alias("i", "arg"), "indirect", "ord")
    name = S.group(F.col("arg"), r"^&?(\w+)$")
    context = F.when(F.col("indirect"), "arg_to_indirect").otherwise("arg_to_call")
    return each.where(F.col("arg").rlike(r"^&\w+$")).select(F.lit(None).cast("string").alias("structType"), F.concat(F.lit("arg"), F.col("i")).alias("fieldName"), name.alias("targetFn"), F.col("file").alias("sourceFile"), "line", context.alias("context"), "ord")


def alias_names(copies: DataFrame, rounds: int = 8) -> DataFrame:
    """version, of (the version it copies) or name -> version, name: names carried along copies, the last definition of a version."""
    from plumbline.operators.constants import closure

    last = copies.groupBy("version").agg(F.max_by(F.struct("of", "name"), "ord").alias("r")).select("version", "r.*")
    base = last.where("name IS NOT NULL").select(F.col("version").alias("name"), F.col("name").alias("value"))
    return closure(last.where("name IS NULL AND of IS NOT NULL").select(F.col("version").alias("name"), F.col("of").alias("ref")), base, rounds).select(F.col("name").alias("version"), F.col("value").alias("name"))


# Validation


def reject_reason(kinds: dict[str, tuple[str, ...]] = schemas.REQUIRED) -> Column:
    """Why a compiler record is left out, null if it isn't: its type, a missing field, a value that is no number."""
    known = F.col("type").isin(*kinds)
    missing = F.lit(False)
    for kind, fields in kinds.items():
        lack = F.lit(False)
        for f in fields:
            lack = lack | F.col(f).isNull()
        missing = missing | ((F.col("type") == kind) & lack)
    number = (F.col("type") == "BranchCondition") & F.expr("try_cast(conditionRHSValue AS DOUBLE)").isNull()
    return F.when(~F.coalesce(known, F.lit(False)), "unknown type").when(missing, "missing field").when(number, "not a number")


def validated(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that pass, and how many don't by reason and type."""
    marked = units.withColumn("reject_reason", reject_reason())
    rejects = marked.where("reject_reason IS NOT NULL").groupBy("reject_reason", "type").agg(F.count("*").alias("n"))
    return marked.where("reject_reason IS NULL").drop("reject_reason"), rejects


def merged_units(units: DataFrame) -> DataFrame:
    """Valid compiler records without repeats: calls by ends and file, assignments by struct, field, target and slot, branches by function, test and value."""
    calls = first_wins(units.where("type = 'CallEdge'"), ["callerFn", "calleeFn", "file"])
    keyed = units.where("type = 'FnPtrAssignment'").withColumn("_struct", F.coalesce("structType", F.lit("")))
    pointers = first_wins(keyed, ["_struct", "fieldName", "targetFn", "arrayIndex"]).drop("_struct")
    tests = first_wins(units.where("type = 'BranchCondition'"), ["function", "conditionLHS", "conditionOp", "conditionRHSValue"])
    return calls.unionByName(pointers).unionByName(tests)


# Conversion and union


def converted(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compiler records as nodes (nodeType) and edges (edgeType) of the graph's shapes."""
    filled = lambda *cs: F.expr(" AND ".join(f"{c} IS NOT NULL AND {c} <> ''" for c in cs))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    edges = units.where("type = 'CallEdge'").where(filled("callerFn", "calleeFn")).select(
        F.lit("CallEdge").alias("edgeType"), "callerFn", "calleeFn", text("file"), F.coalesce("line", F.lit(-1)).alias("line"), F.lit("gcc").alias("source"), "ord"
    )
    pointers = units.where("type = 'FnPtrAssignment'").where(filled("targetFn")).select(
        F.lit("FnPtrAssignment").alias("nodeType"), "structType", text("fieldName"), "targetFn", F.coalesce("sourceFile", "file", F.lit("")).alias("sourceFile"), F.coalesce("line", F.lit(-1)).alias("line"), "arrayIndex", F.lit("gcc").alias("source"), "ord"
    )
    value = F.expr("try_cast(try_cast(conditionRHSValue AS DOUBLE) AS BIGINT)")
    exact = F.coalesce(F.expr("try_cast(conditionRHSValue AS BIGINT)"), value)
    tests = units.where("type = 'BranchCondition'").where(filled("function")).select(
        F.lit("BranchCondition").alias("nodeType"), "function", text("conditionLHS"), text("conditionOp"), exact.alias("conditionRHSValue"), text("conditionRHSLabel"), F.coalesce("lhsArgPos", F.lit(-1)).alias("lhsArgPos"), F.lit("gcc").alias("source"), "ord"
    )
    return pointers.unionByName(tests, allowMissingColumns=True), edges


def stubs(referenced: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """An external function for every name that is referenced and not known."""
    lost = referenced.select(F.col(name).alias("name")).where("name IS NOT NULL AND name <> ''").distinct().join(known.select("name").distinct(), "name", "left_anti")
    none = F.lit("")
    return lost.select(F.lit("Function").alias("nodeType"), "name", F.col("name").alias("fullName"), none.alias("file"), F.lit(-1).alias("line"), none.alias("signature"), F.lit(True).alias("isExternal"), none.alias("subsystem"), F.lit("gcc_stub").alias("source"))


def unified(nodes: DataFrame, edges: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both producers' nodes and edges in one, with stubs, trusted repeats only, and a dense `gid` for each node.

    The first producer's rows come before the compiler's. Of equal calls and equal assignments a compiler's row wins.
    """
    extra_nodes, extra_edges = converted(units)
    refs = extra_edges.select(F.explode(F.array("callerFn", "calleeFn")).alias("name"))
    refs = refs.unionByName(extra_nodes.select(F.coalesce("targetFn", "function").alias("name")))
    new = stubs(refs, nodes.where("nodeType = 'Function'"))
    place = lambda df, k: df.withColumn("_class", F.lit(k))
    all_nodes = place(nodes, 0).unionByName(place(extra_nodes, 1), allowMissingColumns=True).unionByName(place(new.withColumn("ord", F.lit(0).cast("long")), 2), allowMissingColumns=True)
    all_edges = place(edges, 0).unionByName(place(extra_edges, 1), allowMissingColumns=True)
    gcc = F.coalesce(F.col("source") == "gcc", F.lit(False))
    at = F.struct("_class", "ord")
    pointers = trusted_first(all_nodes.where("nodeType = 'FnPtrAssignment'").withColumn("_at", at), ["fieldName", "targetFn", "arrayIndex"], gcc, "_at").drop("_at")
    kept_nodes = all_nodes.where("nodeType <> 'FnPtrAssignment'").unionByName(pointers)
    calls = trusted_first(all_edges.where("edgeType = 'CallEdge'").withColumn("_at", at), ["callerFn", "calleeFn"], gcc, "_at").drop("_at")
    kept_edges = all_edges.where("edgeType <> 'CallEdge'").unionByName(calls)
    return with_global_ids(kept_nodes, ["_class", "ord", "name"]).drop("_class"), renumbered(kept_edges, ["_class", "ord"]).drop("_class")


def renumbered(df: DataFrame, order: list[str]) -> DataFrame:
    return dense(df, order, "ord")


def with_global_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """gid and ord: the row's place, from 0, in `order`."""
    return dense(df, order, "gid").withColumn("ord", F.col("gid"))


def dense(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Places from 0 without a gap. Rows are sorted in ranges and numbered in each; only the ranges' sizes meet in one task."""
    spark = df.sparkSession
    n = min(4096, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    from plumbline.sources.shared import Scratch

    kept = Scratch(spark, "dense").keep(sorted_)
    first = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_low"))
    start = first.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return kept.join(F.broadcast(start.select("_part", "_low", "_start")), "_part").withColumn(name, F.col("_start") + F.col("_place") - F.col("_low")).drop("_part", "_place", "_low", "_start")

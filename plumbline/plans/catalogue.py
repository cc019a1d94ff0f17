"""The engine's operators as queries over the driver's tables, each with SQL that makes the same rows.

The tables hold no program, so each query takes a projection of them that has the shape its operator works on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import constants, dedup, graph, records, report, stitch, subsystems, traverse
from plumbline.streaming import observations as obs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Deduplication and upserts


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_first_wins(spark, d):
    return dedup.first_wins(t(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("""SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderstatus = 'F' DESC, o_orderkey) = 1""")
def dedup_trust_ranked(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    return dedup.trusted_first(o, ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") == "F", "o_orderkey")


@query("""SELECT nullif(o_orderstatus, 'O') AS status, o_orderpriority, o_orderkey, o_custkey FROM orders
QUALIFY row_number() OVER (PARTITION BY nullif(o_orderstatus, 'O'), o_orderpriority ORDER BY o_orderkey) = 1""")
def dedup_nullsafe_key(spark, d):
    o = t(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("O")).alias("status"), "o_orderpriority", "o_orderkey", "o_custkey")
    return dedup.first_wins(o, ["status", "o_orderpriority"], ["o_orderkey"])


@query("""SELECT o_custkey, coalesce(arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'P'), arg_max(o_orderstatus, o_orderkey)) AS status,
arg_min(o_orderpriority, o_orderkey) AS priority, min(o_orderkey) AS ord FROM orders GROUP BY o_custkey""")
def upsert_fill_empty(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("ord"))
    return dedup.upsert(o, ["o_custkey"], {"status": dedup.fill(dedup.filled("status", "P"))})


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'F' ELSE arg_min(o_orderstatus, o_orderkey) END AS status,
coalesce(arg_max(o_totalprice, o_orderkey) FILTER (o_totalprice >= 100000), arg_min(o_totalprice, o_orderkey)) AS price, min(o_orderkey) AS ord
FROM orders GROUP BY o_custkey""")
def upsert_sticky_last(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ord"))
    return dedup.upsert(o, ["o_custkey"], {"status": dedup.sticky("F"), "price": dedup.latest(F.col("price") >= 100000)})


_NODES = "nodeType", "name", "fullName", "file", "line", "signature", "isExternal", "subsystem"


@query("""WITH e AS (SELECT 'f' || user_id AS name, event_id AS ord, CASE WHEN event_type = 'view' THEN '' ELSE 'net/d' || event_id % 7 || '/a.c' END AS file,
CASE WHEN event_type = 'click' THEN -1 ELSE CAST(event_id % 100 AS INT) END AS line, event_type = 'error' AS ext FROM events),
g AS (SELECT name, coalesce(arg_min(file, ord) FILTER (file <> ''), arg_max(file, ord)) AS file,
coalesce(arg_min(line, ord) FILTER (line <> -1), arg_max(line, ord)) AS line, arg_min(ext, ord) AS "isExternal" FROM e GROUP BY name)
SELECT name, file, line, "isExternal", CASE WHEN contains(file, '/') THEN 'net' END AS subsystem FROM g""")
def load_functions(spark, d):
    e = t(spark, d, "events")
    nodes = e.select(
        F.lit("Function").alias("nodeType"), F.concat(F.lit("f"), "user_id").alias("name"), F.lit("").alias("fullName"),
        F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("net/d"), F.col("event_id") % 7, F.lit("/a.c"))).alias("file"),
        F.when(F.col("event_type") == "click", -1).otherwise((F.col("event_id") % 100).cast("int")).alias("line"), (F.col("event_type") == "error").alias("isExternal"), F.col("event_id").alias("ord"),
    )
    return graph.functions(nodes).select("name", "file", "line", "isExternal", "subsystem")


@query("""WITH e AS (SELECT 'f' || user_id % 20 AS function, 'v' || event_id % 5 AS lhs, CASE WHEN event_id % 2 = 0 THEN '==' ELSE '<' END AS op, event_id % 9 AS rhs,
event_type IN ('view', 'click') AS gcc, CASE WHEN event_id % 3 = 0 THEN 'L' || event_id % 11 END AS label, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 3 AS INT) ELSE -1 END AS pos, event_id FROM events),
o AS (SELECT *, row_number() OVER (ORDER BY gcc, event_id) AS k FROM e)
SELECT function, lhs, op, CASE WHEN bool_and(gcc) THEN arg_min(rhs, k) END AS rhs, CASE WHEN bool_or(gcc) THEN 'gcc' ELSE 'joern' END AS source,
arg_max(label, k) FILTER (label IS NOT NULL AND gcc) AS label, coalesce(arg_max(pos, k) FILTER (pos >= 0 AND gcc), -1) AS pos
FROM o GROUP BY function, lhs, op""")
def load_branches(spark, d):
    e = t(spark, d, "events")
    gcc = F.col("event_type").isin("view", "click")
    i = F.col("event_id")
    nodes = e.select(
        F.when(gcc, "BranchCondition").otherwise("BranchPoint").alias("nodeType"), F.concat(F.lit("f"), F.col("user_id") % 20).alias("function"), F.concat(F.lit("v"), i % 5).alias("conditionLHS"),
        F.when(i % 2 == 0, "==").otherwise("<").alias("conditionOp"), F.when(gcc, i % 9).alias("conditionRHSValue"), F.lit(None).cast("string").alias("conditionRHS"), F.lit(None).cast("string").alias("branchType"),
        F.when(gcc, "gcc").otherwise("joern").alias("source"), F.when(gcc & (i % 3 == 0), F.concat(F.lit("L"), i % 11)).alias("conditionRHSLabel"), F.when(gcc & (i % 4 == 0), (i % 3).cast("int")).otherwise(-1).alias("lhsArgPos"), i.alias("ord"),
    )
    b = graph.branches(nodes)
    return b.select("function", F.col("conditionLHS").alias("lhs"), F.col("conditionOp").alias("op"), F.col("conditionRHSValue").alias("rhs"), "source", F.col("conditionRHSLabel").alias("label"), F.col("lhsArgPos").alias("pos"))


@query("""WITH e AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, l_linenumber AS line, l_returnflag, l_orderkey * 10000000 + l_partkey * 1000 + l_suppkey AS ord FROM lineitem),
k AS (SELECT a, b, CASE WHEN bool_or(l_returnflag = 'R') THEN 'gcc' ELSE 'joern' END AS by_ FROM e GROUP BY a, b)
SELECT a AS caller, b AS callee, by_ AS "resolvedBy" FROM k WHERE a IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal >= 0) AND b IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 10)""")
def endpoint_join(spark, d):
    x = t(spark, d, "lineitem")
    order = F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    edges = x.select(F.concat(F.lit("s"), "l_suppkey").alias("callerFn"), F.concat(F.lit("p"), "l_partkey").alias("calleeFn"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "gcc").otherwise("joern").alias("source"), order.alias("ord"))
    s = t(spark, d, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("s"), "s_suppkey").alias("name"))
    p = t(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    return graph.calls(edges, s.unionByName(p)).select(F.col("callerFn").alias("caller"), F.col("calleeFn").alias("callee"), "resolvedBy")


@query("""SELECT DISTINCT 'o' || l_orderkey AS caller, 'x' || l_suppkey AS expression FROM lineitem l
WHERE EXISTS (SELECT 1 FROM lineitem m WHERE m.l_linenumber = 1 AND m.l_orderkey = l.l_orderkey AND m.l_suppkey = l.l_suppkey) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def composite_join(spark, d):
    x = t(spark, d, "lineitem")
    key = lambda df: df.select(F.concat(F.lit("o"), "l_orderkey").alias("callerFn"), F.concat(F.lit("x"), "l_suppkey").alias("callExpression"), F.lit(0).cast("long").alias("ord"))
    sites = key(x.where("l_linenumber = 1")).withColumnRenamed("callerFn", "callerFunction")
    fns = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("name"))
    return graph.indirect_edges(key(x), fns, sites).select(F.col("callerFn").alias("caller"), F.col("callExpression").alias("expression"))


# Stubs, ids, validation


@query("SELECT CAST(o_orderkey AS VARCHAR) AS name, true AS \"isExternal\", 'gcc_stub' AS source FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def stub_insert(spark, d):
    refs = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("name"))
    known = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("name"))
    return records.stubs(refs, known).select("name", "isExternal", "source")


@query("SELECT DISTINCT CASE WHEN l_suppkey >= 90 THEN l_suppkey % 90 ELSE l_suppkey END AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'")
def stub_redirect(spark, d):
    edges = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    s = t(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("id"), (F.when(F.col("s_suppkey") >= 90, F.col("s_suppkey") % 90).otherwise(F.col("s_suppkey"))).alias("name"), (F.col("s_suppkey") >= 90).alias("isExternal"))
    return stitch.redirect(edges, stitch.stub_map(rows), "src")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey < 90 OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'N')")
def stub_cleanup(spark, d):
    rows = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 90).alias("name"), (F.col("s_suppkey") >= 90).alias("isExternal"))
    edges = t(spark, d, "lineitem").where("l_quantity > 49 AND l_returnflag = 'N'").select(F.col("l_suppkey").alias("src"), F.lit(-1).cast("long").alias("dst"))
    return stitch.drop_unlinked_stubs(rows, stitch.stub_map(rows), edges).select("id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS gid FROM orders")
def global_ids(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("k"))
    return records.dense(o, ["k", "o_orderkey"], "gid").select("o_orderkey", "gid")


_UNITS = """SELECT CASE event_type WHEN 'view' THEN 'CallEdge' WHEN 'click' THEN 'FnPtrAssignment' WHEN 'purchase' THEN 'BranchCondition' ELSE 'Other' END AS type, event_id AS i, user_id AS u FROM events"""


def _units(spark, d):
    from plumbline import schemas

    i, u = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "view", "CallEdge").when(F.col("event_type") == "click", "FnPtrAssignment").when(F.col("event_type") == "purchase", "BranchCondition").otherwise("Other")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    made = {
        "type": kind, "callerFn": name("f", u % 30), "calleeFn": F.when(i % 7 != 0, name("g", i % 20)), "file": name("d", i % 3), "line": (i % 50).cast("int"), "structType": F.when(i % 2 == 0, "ops"),
        "fieldName": F.when(i % 11 != 0, name("m", i % 6)), "targetFn": name("g", u % 25), "sourceFile": F.lit("a.c"), "arrayIndex": F.when(i % 5 == 0, i % 4), "function": name("f", u % 30), "conditionOp": F.lit("=="),
        "conditionLHS": name("v", i % 4), "conditionRHSLabel": F.lit(""), "conditionRHSValue": F.when(i % 13 == 0, "x").otherwise((i % 8).cast("string")), "lhsArgPos": F.lit(-1),
    }
    from pyspark.sql.types import StructType

    cols = [made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schemas.UNIT).fields]
    return t(spark, d, "events").select(*cols, i.alias("ord"))


@query(f"""WITH e AS ({_UNITS}), r AS (SELECT type, CASE WHEN type = 'Other' THEN 'unknown type' WHEN type = 'CallEdge' AND i % 7 = 0 OR type = 'FnPtrAssignment' AND i % 11 = 0 THEN 'missing field'
WHEN type = 'BranchCondition' AND i % 13 = 0 THEN 'not a number' END AS reject_reason FROM e) SELECT reject_reason, type, count(*) AS n FROM r WHERE reject_reason IS NOT NULL GROUP BY ALL""")
def reject_counters(spark, d):
    return records.validated(_units(spark, d))[1]


@query(f"""WITH e AS ({_UNITS}) SELECT type, min(i) AS ord FROM e WHERE type = 'CallEdge' AND i % 7 <> 0 GROUP BY type, u % 30, i % 20, i % 3
UNION ALL SELECT type, min(i) FROM e WHERE type = 'FnPtrAssignment' AND i % 11 <> 0 GROUP BY type, i % 2, i % 6, u % 25, CASE WHEN i % 5 = 0 THEN i % 4 END
UNION ALL SELECT type, min(i) FROM e WHERE type = 'BranchCondition' AND i % 13 <> 0 GROUP BY type, u % 30, i % 4, i % 8""")
def merge_compiler_records(spark, d):
    return records.merged_units(records.validated(_units(spark, d))[0]).select("type", "ord")


@query(f"""WITH e AS ({_UNITS}), refs AS (SELECT 'f' || u % 30 AS name FROM e WHERE type = 'CallEdge' AND i % 7 <> 0 UNION SELECT 'g' || i % 20 FROM e WHERE type = 'CallEdge' AND i % 7 <> 0
UNION SELECT 'g' || u % 25 FROM e WHERE type = 'FnPtrAssignment' AND i % 11 <> 0 UNION SELECT 'f' || u % 30 FROM e WHERE type = 'BranchCondition' AND i % 13 <> 0),
known AS (SELECT 'f' || s_suppkey AS name, s_suppkey AS k FROM supplier)
SELECT 'Function' AS kind, name, c = 2 AS stub FROM
(SELECT 0 AS c, k, name FROM known UNION ALL SELECT 2, 0, name FROM refs WHERE name NOT IN (SELECT name FROM known)) x""")
def unify_with_stubs(spark, d):
    from plumbline import schemas

    known = t(spark, d, "supplier").select(F.lit("Function").alias("nodeType"), F.concat(F.lit("f"), "s_suppkey").alias("name"), F.lit(False).alias("isExternal"), F.lit("joern").alias("source"), F.col("s_suppkey").alias("ord"))
    none = spark.createDataFrame([], "edgeType string, " + schemas.merged(*schemas.EDGES.values()) + ", ord bigint")
    shape = spark.createDataFrame([], "nodeType string, " + schemas.merged(*schemas.NODES.values()) + ", ord bigint")
    units = records.merged_units(records.validated(_units(spark, d))[0])
    nodes, _ = records.unified(shape.unionByName(known, allowMissingColumns=True), none, units)
    return nodes.where("nodeType = 'Function'").select(F.col("nodeType").alias("kind"), "name", (F.col("source") == "gcc_stub").alias("stub"))


# Graph passes


def _g1(spark, d, linked="true"):
    """Orders as functions, and their calls: an order's customer calls it, if the order is `linked`."""
    o = t(spark, d, "orders")
    name = lambda c: F.concat(F.lit("n"), F.col(c))
    fns = o.select(name("o_orderkey").alias("name"), (F.col("o_orderpriority") == "5-LOW").alias("isExternal"), F.lit(None).cast("string").alias("subsystem"))
    return fns, o.where(linked).select(name("o_custkey").alias("callerFn"), name("o_orderkey").alias("calleeFn")).distinct()


@query("""WITH n AS (SELECT o_orderkey AS k, o_orderpriority = '5-LOW' AS ext FROM orders), e AS (SELECT o_custkey AS a, o_orderkey AS b FROM orders WHERE o_orderstatus = 'F')
SELECT 'n' || k AS name FROM n WHERE NOT ext AND k NOT IN (SELECT a FROM e UNION SELECT b FROM e)""")
def orphan_nodes(spark, d):
    fns, edges = _g1(spark, d, "o_orderstatus = 'F'")
    return stitch.orphan_flags(fns, edges).where("orphan").select("name")


def _regional(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    of = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = t(spark, d, "customer").join(of, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("r_name").alias("subsystem"))
    s = t(spark, d, "supplier").join(of, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.when(F.col("s_suppkey") % 10 != 0, F.col("r_name")).otherwise("").alias("subsystem"))
    pairs = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("callerFn"), F.concat(F.lit("s"), "l_suppkey").alias("calleeFn")).distinct()
    fns = c.unionByName(s)
    return stitch.tag_crossing(pairs.withColumn("crossSubsystem", F.lit(None).cast("boolean")), fns), fns


_REGIONAL = """WITH r AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
x AS (SELECT c, s, a.r_name AS ra, CASE WHEN s % 10 <> 0 THEN b.r_name END AS rb FROM e JOIN customer ON c_custkey = c JOIN r a ON a.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = s JOIN r b ON b.n_nationkey = s_nationkey)"""


@query(_REGIONAL + " SELECT 'c' || c AS caller, 's' || s AS callee, CASE WHEN ra <> rb THEN true END AS crosses FROM x")
def cross_tag(spark, d):
    return _regional(spark, d)[0].select(F.col("callerFn").alias("caller"), F.col("calleeFn").alias("callee"), F.col("crossSubsystem").alias("crosses"))


@query(_REGIONAL + " SELECT DISTINCT ra AS src, rb AS dst FROM x WHERE ra <> rb")
def rollup_calls_into(spark, d):
    return stitch.crossings(*_regional(spark, d))


@query("SELECT 'p' || l_partkey AS name, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 25")
def hub_filter(spark, d):
    edges = t(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("callerFn"), F.concat(F.lit("p"), "l_partkey").alias("calleeFn"))
    return graph.bulk_caller_counts(edges, 25)


@query("""WITH o AS (SELECT o_orderkey, 'f' || o_orderkey % 50 AS field, o_orderkey % 7 + 1 AS idx, o_orderkey % 3 = 0 AS has FROM orders),
p AS (SELECT DISTINCT 'f' || l_partkey % 60 AS field, l_linenumber AS idx, 't' || l_suppkey AS target, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rank,
((l_orderkey * 10000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS ord FROM lineitem),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY field, idx ORDER BY rank, ord) = 1),
j AS (SELECT o_orderkey, target, b.idx, CASE WHEN has AND o.idx = b.idx THEN 1 ELSE 2 END AS s, rank, ord FROM o JOIN b USING (field))
SELECT CAST(o_orderkey AS VARCHAR) AS caller, target, CASE s WHEN 1 THEN 'static_fnptr_indexed' ELSE 'static_fnptr_fallback' END AS "resolvedBy", CAST(idx AS BIGINT) AS "arrayIndex"
FROM j QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY s, rank, ord) = 1""")
def resolve_priority(spark, d):
    k = F.col("o_orderkey")
    index = F.when(k % 3 == 0, F.concat(F.lit("["), k % 7 + 1, F.lit("]"))).otherwise("")
    sites = t(spark, d, "orders").select(k.cast("string").alias("callerFunction"), F.concat(F.lit("tab"), index, F.lit("->f"), k % 50, F.lit("(x)")).alias("callExpression"))
    flag = F.col("l_returnflag")
    order = ((F.col("l_orderkey") * 10000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    pointers = t(spark, d, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_partkey") % 60).alias("fieldName"), F.lit(None).cast("string").alias("structType"), F.concat(F.lit("t"), "l_suppkey").alias("targetFn"), F.col("l_linenumber").cast("long").alias("arrayIndex"), F.when(flag == "R", "gcc").when(flag == "A", "joern").otherwise("x").alias("source"), order.alias("ord")
    )
    return stitch.resolutions(sites, pointers).select(F.col("callerFunction").alias("caller"), "target", "resolvedBy", "arrayIndex")


@query("""WITH f AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'sys_' WHEN 1 THEN '__sys_' WHEN 2 THEN '__x64_sys_' WHEN 3 THEN '__arm64_sys_' WHEN 4 THEN '' ELSE 'no_' END || 'c' || p_partkey % 40 AS name FROM part WHERE p_size % 5 = 0),
c AS (SELECT DISTINCT 'c' || p_partkey % 40 AS call FROM part), k AS (SELECT call, p, r FROM c, (VALUES ('sys_', 0), ('__sys_', 1), ('__x64_sys_', 2), ('__arm64_sys_', 3), ('', 4)) v(p, r))
SELECT call, arg_min(p || call, r) AS name FROM k WHERE p || call IN (SELECT name FROM f) GROUP BY call""")
def first_candidate(spark, d):
    p = t(spark, d, "part")
    k = F.col("p_partkey") % 6
    prefix = F.element_at(F.array(*(F.lit(x) for x in ("sys_", "__sys_", "__x64_sys_", "__arm64_sys_", "", "no_"))), (k + 1).cast("int"))
    call = F.concat(F.lit("c"), F.col("p_partkey") % 40)
    return graph.first_existing(p.select(call.alias("call")).distinct(), p.where("p_size % 5 = 0").select(F.concat(prefix, call).alias("name")).distinct())


# Reports


def _counted_graph(spark, d):
    e, o, x = t(spark, d, "events"), t(spark, d, "orders"), t(spark, d, "lineitem")
    c = t(spark, d, "customer").select(F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("isExternal"), (F.col("c_nationkey") == 3).alias("orphan"))
    calls = o.select(F.col("o_custkey").alias("callerFn"), F.col("o_orderkey").alias("calleeFn"), (F.col("o_orderstatus") == "F").alias("crossSubsystem"))
    sites = e.select(F.col("user_id").alias("callerFn"), F.when(F.col("event_type") == "error", "unresolved").otherwise("resolved_static").alias("state"))
    resolves = e.select(F.when(F.col("event_type") != "view", "dynamic").otherwise("static").alias("resolvedBy"), F.when(F.col("value") > 10, "verified").otherwise("stale").alias("state"))
    parts = t(spark, d, "part")
    return graph.CodeGraph(functions=c, parameters=parts, branches=x, constants=t(spark, d, "nation"), indirect_calls=sites, fnptrs=parts, calls=calls, flows=o, indirect_edges=sites, assigns=parts, resolves=resolves, subsystems=t(spark, d, "region"))


@query("""SELECT (SELECT count(*) FROM customer) AS functions, (SELECT count(*) FROM orders) AS call_edges, (SELECT count(*) FROM events) AS indirect_calls, (SELECT count(*) FROM lineitem) AS branch_points,
(SELECT count(*) FROM nation) AS constants, count(*) FILTER (event_type <> 'view') AS dynamic_edges, count(*) FILTER (event_type <> 'view' AND value > 10) AS dynamic_verified,
count(*) FILTER (event_type <> 'view' AND NOT value > 10) AS dynamic_stale FROM events""")
def status_counts(spark, d):
    return report.status(_counted_graph(spark, d))


@query("""WITH c AS (SELECT count(*) AS functions, count(*) FILTER (c_acctbal < 0) AS external, count(*) FILTER (c_nationkey = 3) AS orphans FROM customer),
o AS (SELECT count(*) AS call_edges, count(*) FILTER (o_orderstatus = 'F') AS cross_calls FROM orders), e AS (SELECT count(*) AS indirect, count(*) FILTER (event_type = 'error') AS unresolved FROM events)
SELECT functions, external, orphans, call_edges, cross_calls, indirect, unresolved, round(unresolved / indirect * 100, 6) AS pct, unresolved / indirect * 100 > 30 AS unresolved_alarm, external > functions * 0.2 AS external_alarm,
NOT (unresolved / indirect * 100 > 30) AND NOT (external > functions * 0.2) AS ok FROM c, o, e""")
def health_report(spark, d):
    h = report.health(_counted_graph(spark, d))
    return h.select("functions", "external", "orphans", "call_edges", "cross_calls", "indirect", "unresolved", F.round("unresolved_pct", 6).alias("pct"), "unresolved_alarm", "external_alarm", "ok")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def top_n_groups(spark, d):
    return report.top(t(spark, d, "orders"), "o_custkey", 10)


@query("SELECT coalesce(nullif(p_type, 'PROMO'), '<no struct>') AS p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def top_with_null_name(spark, d):
    return report.top(t(spark, d, "part").select(F.nullif("p_type", F.lit("PROMO")).alias("p_type")), "p_type", 10, "<no struct>")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_type(spark, d):
    return report.count_by(t(spark, d, "events"), "event_type")


_PATH = "SELECT user_id, event_id AS seq, CAST(event_id % 5 AS INT) AS depth, CASE WHEN event_id % 9 = 0 THEN 'kmalloc' ELSE 'f' || event_id END AS function, CASE event_type WHEN 'view' THEN 'fn_ptr: x [graph]' ELSE 'direct call' END AS via FROM events"


def _path(spark, d):
    """A path for each user."""
    i = F.col("event_id")
    return t(spark, d, "events").select(
        "user_id", i.alias("seq"), (i % 5).cast("int").alias("depth"), F.when(i % 9 == 0, "kmalloc").otherwise(F.concat(F.lit("f"), i)).alias("function"),
        F.when(F.col("event_type") == "view", "fn_ptr: x [graph]").otherwise("direct call").alias("via"),
    )


@query(f"SELECT user_id, seq, depth, NOT coalesce(lead(depth) OVER (PARTITION BY user_id ORDER BY seq) > depth, false) AS leaf FROM ({_PATH})")
def fmt_leaf(spark, d):
    return report.with_leaves(_path(spark, d), "user_id").select("user_id", "seq", "depth", "leaf")


@query(f"""WITH p AS ({_PATH}), q AS (SELECT *, via <> 'direct call' AS dispatch FROM p WHERE function <> 'kmalloc'),
f AS (SELECT user_id, depth + 1 AS depth, min(seq) AS first FROM q WHERE dispatch GROUP BY ALL)
SELECT user_id, seq, function, dispatch FROM q LEFT JOIN f USING (user_id, depth) WHERE depth = 0 OR dispatch OR first < seq""")
def compact_spine(spark, d):
    return report.spine(_path(spark, d), "user_id").select("user_id", "seq", "function", "dispatch")


@query(r"""WITH u AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/]*/([^/?#]*)/', 1) AS lang FROM pages), k AS (SELECT host || '/' || lang AS key FROM u WHERE host <> '' AND lang <> '')
SELECT '/src/' || key AS path, key, count(*) AS n FROM k GROUP BY key HAVING count(*) >= 3""")
def group_min_files(spark, d):
    host, lang = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/]*/([^/?#]*)/", 1)
    manifest = t(spark, d, "pages").where((host != "") & (lang != "")).select(F.concat(F.lit("/src/"), host, F.lit("/"), lang, F.lit("/"), F.col("page_id"), F.lit(".c")).alias("path"))
    return subsystems.subsystems(manifest, "/src", 2, 3).select("path", "key", "n")


@query("""SELECT CASE WHEN p_partkey % 5 = 0 THEN 'outside' WHEN p_partkey % 5 = 1 THEN 'no folder' WHEN p_partkey % 5 = 2 THEN 'excluded' END AS reason, count(*) AS n FROM part WHERE p_partkey % 5 < 3 GROUP BY 1""")
def skipped_paths(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("/srcs/a/"), k)).when(k % 5 == 1, F.concat(F.lit("/src/"), k)).when(k % 5 == 2, F.concat(F.lit("/src/tools/"), k)).otherwise(F.concat(F.lit("/src/net/"), k))
    return subsystems.skipped(t(spark, d, "part").select(path.alias("path")), "/src")


# Scalars


@query(r"""SELECT p_partkey, regexp_extract(p_name, '^(\w+)', 1) AS field, CAST(p_size AS BIGINT) AS idx, 'f' || p_partkey AS name, p_size || ';' || p_brand AS args FROM part""")
def scalar_parse_call(spark, d):
    word = F.regexp_extract("p_name", r"^(\w+)", 1)
    expr = F.concat(F.lit("tab["), F.col("p_size"), F.lit("]->"), word, F.lit(" (x, y)"))
    call = S.parse_call(F.concat(F.lit("  f"), F.col("p_partkey"), F.lit(" ( "), F.col("p_size"), F.lit(", , "), F.col("p_brand"), F.lit(" ) ")))
    return t(spark, d, "part").select("p_partkey", S.field_name(expr).alias("field"), S.literal_index(expr).alias("idx"), call["name"].alias("name"), F.array_join(call["args"], ";").alias("args"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '(\w+)\s*(==|!=|<=|>=|<|>)\s*(\w+)', 1), '') AS lhs, nullif(regexp_extract(html, '(\w+)\s*(==|!=|<=|>=|<|>)\s*(\w+)', 2), '') AS op,
nullif(regexp_extract(html, '(\w+)\s*(==|!=|<=|>=|<|>)\s*(\w+)', 3), '') AS rhs FROM pages""")
def branch_extract(spark, d):
    p = t(spark, d, "pages").select(F.col("page_id").alias("ord"), F.lit("f").alias("function"), F.col("html").alias("code"))
    return records.branch_points(p).select(F.col("ord").alias("page_id"), F.col("conditionLHS").alias("lhs"), F.col("conditionOp").alias("op"), F.col("conditionRHS").alias("rhs"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey WHEN 2 THEN -o_orderkey WHEN 3 THEN o_orderkey END AS value FROM orders""")
def int_literal_parse(spark, d):
    k = F.col("o_orderkey")
    s = k.cast("string")
    text = F.when(k % 6 == 0, s).when(k % 6 == 1, F.concat(F.lit("0x"), F.hex(k))).when(k % 6 == 2, F.concat(F.lit("-"), s)).when(k % 6 == 3, F.concat(F.lit("0b"), F.bin(k))).when(k % 6 == 4, F.concat(F.lit("0"), s)).otherwise(F.concat(s, F.lit("U")))
    return t(spark, d, "orders").select("o_orderkey", S.int_literal(text).alias("value"))


@query("""SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS arg0, c_custkey AS arg1, CAST(NULL AS BIGINT) AS arg2, CAST(c_nationkey AS BIGINT) AS named FROM customer""")
def resolve_args(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    table = F.create_map(F.col("n_name"), F.col("n_nationkey").cast("long"), F.lit("other"), F.lit(-1).cast("long"))
    env = S.resolve_args(F.array("n_name", F.col("c_custkey").cast("string"), F.lit("x|y")), table)
    return c.select("c_custkey", env["arg0"].alias("arg0"), env["arg1"].alias("arg1"), env["arg2"].alias("arg2"), env[F.col("n_name")].alias("named"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE o_custkey END AS BIGINT) AS arg1, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE o_custkey END AS BIGINT) AS family,
CAST(9 AS BIGINT) AS kept, CAST(NULL AS BIGINT) AS lost FROM orders""")
def propagate_args(spark, d):
    o = t(spark, d, "orders")
    even = F.col("o_orderkey") % 2 == 0
    base = F.create_map(F.lit("arg0"), F.col("o_custkey"), F.lit("argp"), F.lit(1).cast("long"), F.lit("keep"), F.lit(9).cast("long"))
    env = F.when(even, F.map_concat(base, F.create_map(F.lit("family"), F.lit(7).cast("long")))).otherwise(base)
    flows = F.array(F.struct(F.lit(0).alias("from_pos"), F.lit(1).alias("to_pos"), F.lit("family").alias("param")))
    out = S.propagate(env, flows)
    return o.select("o_orderkey", out["arg1"].alias("arg1"), out["family"].alias("family"), out["keep"].alias("kept"), out["argp"].alias("lost"))


@query("""WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN '==' WHEN 1 THEN '!=' WHEN 2 THEN '<' WHEN 3 THEN '<=' WHEN 4 THEN '>' WHEN 5 THEN '>=' ELSE '~' END AS op,
CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey END AS lhs, CAST(l_quantity AS BIGINT) AS rhs FROM lineitem)
SELECT op, CASE op WHEN '==' THEN lhs = rhs WHEN '!=' THEN lhs <> rhs WHEN '<' THEN lhs < rhs WHEN '<=' THEN lhs <= rhs WHEN '>' THEN lhs > rhs WHEN '>=' THEN lhs >= rhs END AS holds, count(*) AS n FROM b GROUP BY ALL""")
def eval_branch(spark, d):
    n = F.col("l_linenumber") % 7
    op = F.element_at(F.array(*(F.lit(x) for x in ("==", "!=", "<", "<=", ">", ">=", "~"))), n + 1)
    env = F.create_map(F.lit("arg2"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")))
    holds = S.branch_holds(op, F.lit("x"), F.col("l_quantity").cast("long"), F.lit(2), env)
    return t(spark, d, "lineitem").select(op.alias("op"), holds.alias("holds")).groupBy("op", "holds").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 4 WHEN 1 THEN 3 WHEN 2 THEN 8 WHEN 3 THEN 5 END AS idx FROM events""")
def match_index(spark, d):
    i = F.col("event_id")
    env = F.create_map(F.lit("v"), i % 4, F.lit("type"), F.lit(8).cast("long"))
    expr = F.when(i % 5 == 0, "tab[v]->f(x)").when(i % 5 == 1, "tab[3]->f(x)").when(i % 5 == 2, "sk->sk_prot->f(x)").otherwise("ops->f(x)")
    return t(spark, d, "events").select("event_id", S.match_index(expr, env, F.when(i % 5 == 3, F.lit(5).cast("long"))).alias("idx"))


@query("""SELECT s_suppkey, 'connect' || s_suppkey AS bare, CASE WHEN s_suppkey % 3 = 0 THEN 'net' WHEN s_suppkey % 3 = 1 THEN 'net/ipv4' END AS key, 'net_ipv4_x.c' AS mangled, s_suppkey % 2 = 0 AS noise FROM supplier""")
def scalar_names(spark, d):
    k = F.col("s_suppkey")
    path = F.when(k % 3 == 0, "net/x.c").when(k % 3 == 1, "net/ipv4/tcp/x.c").otherwise("Makefile")
    prefix = F.element_at(F.array(*(F.lit(x) for x in ("sys_", "__sys_", "__x64_sys_", "__arm64_sys_"))), (k % 4 + 1).cast("int"))
    noisy = F.when(k % 2 == 0, "spin_lock_bh").otherwise("tcp_connect")
    return t(spark, d, "supplier").select("s_suppkey", S.bare_call_name(F.concat(prefix, F.lit("connect"), k)).alias("bare"), S.subsystem_key(path, 2).alias("key"), S.mangle(F.lit("net/ipv4\\x.c")).alias("mangled"), S.is_noise(noisy).alias("noise"))


# Extraction rules


@query("""SELECT 'c' || o_custkey AS caller, 'o' || o_orderkey AS callee FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT 'c' || o_custkey, 'p' || o_orderkey % 10 FROM orders""")
def extract_calls(spark, d):
    first = F.when(F.col("o_orderpriority") == "5-LOW", "__builtin_expect").otherwise(F.concat(F.lit("o"), "o_orderkey"))
    calls = t(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("caller"), F.array(first, F.lit("<operator>.assign"), F.concat(F.lit("p"), F.col("o_orderkey") % 10)).alias("callees"), F.lit("a.c").alias("file"), F.lit(1).alias("line"), F.col("o_orderkey").alias("ord"))
    return records.call_edges(calls).select(F.col("callerFn").alias("caller"), F.col("calleeFn").alias("callee"))


@query("""SELECT o_orderkey, CAST(pos AS INT) AS pos, CASE pos WHEN 0 THEN 'x' ELSE 'y' END AS code, 'q' || pos AS param FROM orders, (VALUES (0), (1)) v(pos) WHERE o_orderkey % 3 <> 0 OR pos = 0""")
def extract_flows(spark, d):
    o = t(spark, d, "orders")
    args = F.array(F.struct(F.lit(2).alias("ord"), F.lit("y").alias("code")), F.struct(F.lit(1).alias("ord"), F.lit("x").alias("code")))
    calls = o.select(F.concat(F.lit("c"), "o_custkey").alias("caller"), F.array(F.concat(F.lit("o"), "o_orderkey")).alias("callees"), args.alias("args"), F.col("o_orderkey").alias("ord"))
    params = o.select(F.concat(F.lit("o"), "o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(F.lit("q0").alias("name"), F.lit("int").alias("type")))).otherwise(F.array(*(F.struct(F.lit(n).alias("name"), F.lit("int").alias("type")) for n in ("q0", "q1")))).alias("params"), F.col("o_orderkey").alias("ord"))
    made = records.dataflow_edges(calls, records.parameters(params))
    return made.select(F.col("ord").alias("o_orderkey"), F.col("callerArgPos").alias("pos"), F.col("callerArgCode").alias("code"), F.col("calleeParamName").alias("param"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'm' || user_id ELSE 'tab' END AS field, 'fn' || event_id AS target, CASE WHEN event_id % 3 <> 0 THEN user_id END AS idx FROM events WHERE event_id % 3 < 2 AND event_type <> 'error'""")
def extract_assignments(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    target = F.when(i % 3 == 0, F.concat(F.lit("ops.m"), u)).when(i % 3 == 1, F.concat(F.lit("tab["), u, F.lit("]"))).otherwise(F.concat(F.lit("ops->m"), u))
    rows = t(spark, d, "events").select(target.alias("target"), F.when(F.col("event_type") == "error", "x").otherwise(F.concat(F.lit("&fn"), i)).alias("value"), F.lit("a.c").alias("file"), F.lit(1).alias("line"), i.alias("ord"))
    return records.fnptr_assignments(rows).select(F.col("ord").alias("event_id"), F.col("fieldName").alias("field"), F.col("targetFn").alias("target"), F.col("arrayIndex").alias("idx"))


@query("""SELECT event_id, 'v' || user_id AS lhs, CASE WHEN event_id % 2 = 0 THEN '>' ELSE '<' END AS op, event_id % 50 AS value FROM events WHERE event_type <> 'error'""")
def extract_tests(spark, d):
    i = F.col("event_id")
    name, number = F.concat(F.lit("v"), "user_id"), (i % 50).cast("string")
    plain = F.col("event_type") != "error"
    rows = t(spark, d, "events").select(F.lit("f").alias("function"), F.when(i % 2 == 0, number).otherwise(name).alias("lhs"), F.lit("<").alias("op"), F.when(i % 2 == 0, name).otherwise(number).alias("rhs"), i.alias("ord"), plain.alias("plain"))
    rows = rows.withColumn("lhs", F.when(F.col("plain"), F.col("lhs")).otherwise("a")).withColumn("rhs", F.when(F.col("plain"), F.col("rhs")).otherwise("b"))
    return records.compiler_branches(rows).select(F.col("ord").alias("event_id"), F.col("conditionLHS").alias("lhs"), F.col("conditionOp").alias("op"), F.col("conditionRHSValue").alias("value"))


@query("""SELECT event_id, v AS value FROM (SELECT event_id, user_id AS v FROM events UNION SELECT event_id, user_id + event_id % 3 FROM events WHERE event_type = 'view')""")
def extract_cases(spark, d):
    rows = t(spark, d, "events").select(F.lit("f").alias("function"), F.lit("k").alias("lhs"), F.col("user_id").alias("low"), F.when(F.col("event_type") == "view", F.col("user_id") + F.col("event_id") % 3).alias("high"), F.col("event_id").alias("ord"))
    return records.switch_branches(rows).select(F.col("ord").alias("event_id"), F.col("conditionRHSValue").alias("value"))


# Constants


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS k, p_partkey AS place FROM part UNION ALL SELECT k, place // 2 FROM w WHERE place >= 10)
SELECT 'P' || k AS name, place * 100 AS value FROM w WHERE place < 10""")
def alias_chain(spark, d):
    p = t(spark, d, "part")
    name = lambda c: F.concat(F.lit("P"), c)
    base = p.where("p_partkey < 10").select(name(F.col("p_partkey")).alias("name"), (F.col("p_partkey") * 100).alias("value"))
    refs = p.where("p_partkey >= 10").select(name(F.col("p_partkey")).alias("name"), name(F.floor(F.col("p_partkey") / 2)).alias("ref"))
    return constants.closure(refs, base)


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN event_id % 100 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT 'h' || user_id AS path, 'E' || event_id AS name, coalesce(last_value(v - rn IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) + rn AS value FROM e""")
def enum_counter(spark, d):
    e = t(spark, d, "events")
    entry = F.concat(F.lit("  E"), F.col("event_id"), F.when(F.col("event_type") == "signup", F.concat(F.lit(" = "), F.col("event_id") % 100)).otherwise(""), F.lit(", /* enum } */"))
    path = F.concat(F.lit("h"), F.col("user_id"))
    row = lambda df, no, text: df.select(path.alias("path"), F.lit(0).alias("header_rank"), no.cast("int").alias("line_no"), text.alias("text"))
    users = e.select("user_id").distinct()
    lines = row(e, F.col("event_id") + 1, entry).unionByName(row(users, F.lit(0), F.lit("enum kind {"))).unionByName(row(users, F.lit(2**30), F.lit("};")))
    return constants.definitions(lines)[0].select("path", "name", "value")


@query("""SELECT 'C_' || p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS BIGINT) ELSE p_partkey END AS value, CASE WHEN p_partkey % 4 = 0 THEN 'a.h' ELSE 'b.h' END AS source FROM part
UNION ALL SELECT 'Q_' || p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS BIGINT) ELSE p_partkey END, 'b.h' FROM part""")
def extract_constants(spark, d):
    p = t(spark, d, "part")
    k = F.col("p_partkey")
    row = lambda df, path, rank, no, text: df.select(F.lit(path).alias("path"), F.lit(rank).alias("header_rank"), no.cast("int").alias("line_no"), text.alias("text"))
    define = lambda name, value: F.concat(F.lit("#define "), F.lit(name), k, F.lit("  "), value)
    lines = row(p.where("p_partkey % 4 = 0"), "a.h", 0, k, define("C_", F.col("p_size"))).unionByName(row(p, "b.h", 1, k * 3, F.concat(define("C_", F.concat(F.lit("0x"), F.hex(k))), F.lit(" /* hex */"))))
    lines = lines.unionByName(row(p, "b.h", 1, k * 3 + 1, define("Q_", F.concat(F.lit("C_"), k)))).unionByName(row(p, "b.h", 1, k * 3 + 2, define("U_", F.lit("1U"))))
    return constants.extract_constants(lines)


# Traversal


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, o_orderkey AS b FROM orders), w AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN e ON a = node WHERE depth < 30)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def bfs_depth_sparse(spark, d):
    edges = t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return traverse.reach(edges, spark.range(3, 4).select(F.col("id").alias("node")), 30)


_G2 = "SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R'"


def _g2(spark, d):
    return t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS ({_G2}), w AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN e ON a = node WHERE depth < 8) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def bfs_depth_cyclic(spark, d):
    return traverse.reach(_g2(spark, d), spark.range(1, 2).select(F.col("id").alias("node")), 8)


@query(f"""WITH RECURSIVE e AS ({_G2}), h AS (SELECT b FROM e GROUP BY b HAVING count(*) > 8), f AS (SELECT * FROM e WHERE b NOT IN (SELECT b FROM h) AND (a + b) % 7 <> 0),
w AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT f.b, depth + 1 FROM w JOIN f ON f.a = node WHERE depth < 8) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def bfs_hub_pruned(spark, d):
    e = _g2(spark, d)
    hubs = graph.bulk_caller_counts(e.select(F.col("src").alias("callerFn"), F.col("dst").alias("calleeFn")), 8).select(F.col("name").alias("node"))
    return traverse.reach(e.where("(src + dst) % 7 <> 0"), spark.range(1, 2).select(F.col("id").alias("node")), 8, hubs)


# The order of visits: level by level, in each by the first place of a caller, then by name.
@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey AS b FROM orders), hubs AS (SELECT b FROM e GROUP BY b HAVING count(*) > 20),
r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN e ON a = node WHERE depth < 30 AND b NOT IN (SELECT b FROM hubs)),
least AS (SELECT node, min(depth) AS depth FROM r GROUP BY node),
w AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth, CAST(1 AS BIGINT) AS place
UNION ALL SELECT e.b, w.depth + 1, row_number() OVER (ORDER BY min(w.place), 'n' || e.b) FROM w JOIN e ON e.a = w.node JOIN least l ON l.node = e.b AND l.depth = w.depth + 1 GROUP BY e.b, w.depth)
SELECT row_number() OVER (ORDER BY depth, place) - 1 AS seq, depth, 'n' || node AS function, CASE depth WHEN 0 THEN 'syscall entry' ELSE 'direct call' END AS via FROM w ORDER BY seq LIMIT 500""")
def bfs_order_path(spark, d):
    """The ordered traversal of direct calls; its other rules are tested on graphs made by hand."""
    fns, edges = _g1(spark, d)
    g = _graph(spark, functions=fns.select("name", "isExternal"), calls=edges.withColumn("crossSubsystem", F.lit(False)))
    return traverse.traverse(g, "n3", {"arg0": 1}).path.select("seq", "depth", "function", "via")


# Observations


_EDGES = """SELECT CAST(user_id AS VARCHAR) AS "callerFunction", event_type AS "callExpression", 't' || arg_max(event_id, event_id) % 5 AS target,
CASE WHEN user_id % 2 = 0 THEN 'dynamic' ELSE 'static' END AS "resolvedBy", CASE WHEN user_id % 3 <> 0 THEN 'verified' END AS state FROM events WHERE value < 20 GROUP BY user_id, event_type"""


def _edges(spark, d):
    e = t(spark, d, "events").where("value < 20").groupBy("user_id", "event_type").agg(F.max("event_id").alias("m"))
    u = F.col("user_id")
    return e.select(u.cast("string").alias("callerFunction"), F.col("event_type").alias("callExpression"), F.concat(F.lit("t"), F.col("m") % 5).alias("target"), F.when(u % 2 == 0, "dynamic").otherwise("static").alias("resolvedBy"), F.when(u % 3 != 0, "verified").alias("state"), F.lit(None).cast("long").alias("validUntil"))


@query(f"""SELECT "callerFunction", "callExpression", CASE WHEN "resolvedBy" = 'dynamic' AND state <> 'stale' THEN 'stale' ELSE state END AS state FROM ({_EDGES})""")
def stale_mark(spark, d):
    return obs.mark_stale(_edges(spark, d)).select("callerFunction", "callExpression", "state")


@query(f"""WITH e AS ({_EDGES}), s AS (SELECT *, CASE WHEN "resolvedBy" = 'dynamic' AND state = 'verified' THEN 'stale' ELSE state END AS st FROM e),
o AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS x, 't' || arg_max(event_id, event_id) % 7 AS hit FROM events WHERE value >= 20 GROUP BY user_id, event_type)
SELECT "callerFunction", "callExpression", CASE WHEN st = 'stale' AND hit IS NOT NULL THEN hit ELSE target END AS target, CASE WHEN st = 'stale' AND hit IS NOT NULL THEN 'verified' ELSE st END AS state,
CASE WHEN st = 'stale' AND hit IS NOT NULL THEN CAST(1700000000 + 7 * 86400 AS BIGINT) END AS "validUntil" FROM s LEFT JOIN o ON u = "callerFunction" AND x = "callExpression" """)
def ttl_checkup(spark, d):
    e = t(spark, d, "events").where("value >= 20")
    seen = e.select(F.col("user_id").cast("string").alias("caller_fn"), F.col("event_type").alias("call_site"), F.concat(F.lit("t"), F.col("event_id") % 7).alias("hit_fn"), F.col("event_id").alias("ts"))
    return obs.checkup(obs.mark_stale(_edges(spark, d)), seen, F.lit(1700000000).cast("long")).select("callerFunction", "callExpression", "target", "state", "validUntil")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'enter' WHEN 'purchase' THEN 'hit' WHEN 'error' THEN 'exit' ELSE 'other' END AS ev FROM events),
c AS (SELECT *, sum(CASE WHEN ev = 'enter' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call FROM e),
g AS (SELECT user_id, call, min(ts) FILTER (ev = 'enter') AS entered, arg_min(event_id, (ts, event_id)) FILTER (ev = 'hit') AS hit_id, min(ts) FILTER (ev = 'hit') AS hit_at,
arg_min(event_id, (ts, event_id)) FILTER (ev = 'exit') AS exit_id, min(ts) FILTER (ev = 'exit') AS closed FROM c WHERE call > 0 GROUP BY user_id, call),
f AS (SELECT *, coalesce(hit_at <= entered + INTERVAL 12 HOUR AND NOT coalesce((hit_at, hit_id) > (closed, exit_id), false), false) AS fine FROM g)
SELECT CAST(user_id AS VARCHAR) AS tid, epoch_us(entered) AS entered, CASE WHEN fine THEN 'f' || hit_id END AS hit_fn FROM f""")
def probe_first_hit(spark, d):
    kind = F.col("event_type")
    ev = F.when(kind == "view", "enter").when(kind == "purchase", "hit").when(kind == "error", "exit").otherwise("other")
    rows = t(spark, d, "events").select(F.col("user_id").cast("string").alias("tid"), F.col("ts").cast("timestamp").alias("ts"), ev.alias("event"), F.concat(F.lit("f"), "event_id").alias("fn"), F.col("event_id").alias("ord"))
    return obs.first_hits(rows, 12 * 3600).select("tid", F.unix_micros("entered").alias("entered"), "hit_fn")


# Node and edge tables


def _graph(spark, **frames):
    """A graph of the given tables; the others are empty."""
    from plumbline import schemas

    zero = lambda ddl: spark.createDataFrame([], ddl + ", ord bigint")
    empty = {
        "functions": zero(schemas.FUNCTION), "parameters": zero(schemas.PARAMETER), "branches": zero(schemas.BRANCH_POINT), "constants": zero(schemas.CONSTANT), "indirect_calls": zero(schemas.INDIRECT_CALL), "fnptrs": zero(schemas.FNPTR_ASSIGNMENT),
        "calls": zero("callerFn string, calleeFn string, crossSubsystem boolean"), "flows": zero(schemas.DATAFLOW_EDGE), "indirect_edges": zero("callerFn string, callExpression string"), "assigns": zero("fieldName string"), "resolves": spark.createDataFrame([], schemas.RESOLVES_TO),
    }
    return graph.CodeGraph(**(empty | frames))


@query("""WITH e AS (SELECT CASE WHEN event_id % 10 <> 0 THEN 'f' || user_id END AS f, CAST(CASE WHEN event_type = 'error' THEN -1 ELSE event_id % 6 END AS INT) AS pos, event_id, event_type FROM events)
SELECT f AS "functionName", pos AS "position", 'p' || min(event_id) AS name, coalesce(arg_min(CASE WHEN event_type <> 'view' THEN {'x': event_type} ELSE {'x': ''} END, event_id).x, '') AS "typeFullName"
FROM e WHERE f IS NOT NULL GROUP BY f, pos""")
def load_parameters(spark, d):
    i, kind = F.col("event_id"), F.col("event_type")
    nodes = t(spark, d, "events").select(
        F.when(i % 10 != 0, F.concat(F.lit("f"), "user_id")).alias("functionName"), F.when(kind != "error", (i % 6).cast("int")).alias("position"), F.concat(F.lit("p"), i).alias("name"), F.when(kind != "view", kind).alias("typeFullName"), i.alias("ord"),
    )
    return graph.parameters(nodes).select("functionName", "position", "name", "typeFullName")


@query("""WITH e AS (SELECT 'C' || user_id AS name, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS value, event_type AS source, event_id FROM events)
SELECT name, arg_min({'v': value}, event_id).v AS value, arg_min(source, event_id) AS source FROM e GROUP BY name""")
def load_constants(spark, d):
    i = F.col("event_id")
    rows = t(spark, d, "events").select(F.concat(F.lit("C"), "user_id").alias("name"), F.when(i % 4 == 0, F.concat(F.lit("99999999999999999999"), i)).otherwise(i.cast("string")).alias("value"), F.col("event_type").alias("source"), i.alias("ord"))
    return graph.constants(rows).select("name", "value", "source")


@query("""WITH e AS (SELECT 'f' || user_id AS f, event_type || '(x)' AS x, event_id FROM events WHERE event_id % 8 <> 0)
SELECT f AS "callerFunction", x AS "callExpression", 'a' || min(event_id) % 3 AS file, CAST(min(event_id) % 90 AS INT) AS line, 'unresolved' AS state FROM e GROUP BY f, x""")
def load_indirect_calls(spark, d):
    i = F.col("event_id")
    nodes = t(spark, d, "events").select(F.concat(F.lit("f"), "user_id").alias("callerFunction"), F.when(i % 8 != 0, F.concat("event_type", F.lit("(x)"))).alias("callExpression"), F.concat(F.lit("a"), i % 3).alias("file"), (i % 90).cast("int").alias("line"), i.alias("ord"))
    return graph.indirect_calls(nodes).select("callerFunction", "callExpression", "file", "line", "state")


_POINTERS = """SELECT 'm' || l_partkey % 80 AS f, 't' || l_suppkey AS target, CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS BIGINT) END AS idx, CASE WHEN l_returnflag = 'R' THEN 'gcc' ELSE 'joern' END AS source,
CASE WHEN l_tax < 0.04 THEN 'ops' || l_partkey % 5 END AS st, ((l_orderkey * 10000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS ord FROM lineitem"""


def _pointers(spark, d):
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    order = ((F.col("l_orderkey") * 10000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")) * 10 + n
    return t(spark, d, "lineitem").select(
        F.when(F.col("l_tax") < 0.04, F.concat(F.lit("ops"), F.col("l_partkey") % 5)).alias("structType"), F.concat(F.lit("m"), F.col("l_partkey") % 80).alias("fieldName"), F.concat(F.lit("t"), "l_suppkey").alias("targetFn"),
        F.when(n > 3, n.cast("long")).alias("arrayIndex"), F.when(flag == "R", "gcc").otherwise("joern").alias("source"), F.lit("FnPtrAssignment").alias("nodeType"), order.alias("ord"),
    )


@query(f"""WITH p AS ({_POINTERS}) SELECT f AS "fieldName", target AS "targetFn", CASE WHEN bool_or(source = 'gcc') THEN 'gcc' ELSE 'joern' END AS source,
arg_max(idx, ord) FILTER (idx IS NOT NULL) AS "arrayIndex" FROM p GROUP BY f, target""")
def load_fnptrs(spark, d):
    return graph.fnptrs(_pointers(spark, d)).select("fieldName", "targetFn", "source", "arrayIndex")


@query(f"""WITH p AS ({_POINTERS}) SELECT f AS "fieldName", target AS "targetFn", idx AS "arrayIndex", CASE WHEN bool_or(source = 'gcc') THEN 'gcc' ELSE 'joern' END AS source FROM p
WHERE target IN (SELECT 't' || s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY f, target, idx""")
def assign_edges(spark, d):
    fns = t(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("t"), "s_suppkey").alias("name"))
    return graph.assigns(graph.fnptrs(_pointers(spark, d), "full"), fns).select("fieldName", "targetFn", "arrayIndex", F.col("resolvedBy").alias("source"))


@query(f"""WITH p AS ({_POINTERS}) SELECT f AS "fieldName", target AS "targetFn", idx AS "arrayIndex", arg_min(source, (source <> 'gcc', ord)) AS source, arg_min({{'s': st}}, (source <> 'gcc', ord)).s AS "structType" FROM p GROUP BY f, target, idx""")
def unify_pointers(spark, d):
    """Of assignments that both producers have the compiler's stays, else the first."""
    from plumbline import schemas

    shape = spark.createDataFrame([], "nodeType string, " + schemas.merged(*schemas.NODES.values()) + ", ord bigint")
    none = spark.createDataFrame([], "edgeType string, " + schemas.merged(*schemas.EDGES.values()) + ", ord bigint")
    nodes, _ = records.unified(shape.unionByName(_pointers(spark, d), allowMissingColumns=True), none, spark.createDataFrame([], schemas.UNIT + ", ord bigint"))
    return nodes.where("nodeType = 'FnPtrAssignment'").select("fieldName", "targetFn", "arrayIndex", "source", "structType")


_FLOWS = """SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, CAST(l_linenumber - 1 AS INT) AS i, CAST(CASE WHEN l_discount > 0.05 THEN -1 ELSE l_quantity END AS INT) AS j, l_returnflag AS code, l_orderkey AS ord FROM lineitem"""


def _flows(spark, d):
    return t(spark, d, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("callerFn"), F.concat(F.lit("p"), "l_partkey").alias("calleeFn"), (F.col("l_linenumber") - 1).cast("int").alias("callerArgPos"), F.when(F.col("l_discount") <= 0.05, F.col("l_quantity").cast("int")).alias("calleeParamPos"),
        F.col("l_returnflag").alias("callerArgCode"), F.col("l_orderkey").alias("ord"),
    )


@query(f"""WITH e AS ({_FLOWS}) SELECT a AS "callerFn", b AS "calleeFn", i AS "callerArgPos", j AS "calleeParamPos", '' AS "calleeParamName", min(ord) AS ord FROM e
WHERE a IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal >= 0) AND b IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 10) GROUP BY a, b, i, j""")
def load_flows(spark, d):
    s = t(spark, d, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("s"), "s_suppkey").alias("name"))
    p = t(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    return graph.flows(_flows(spark, d), s.unionByName(p)).select("callerFn", "calleeFn", "callerArgPos", "calleeParamPos", "calleeParamName", "ord")


@query("""WITH p AS (SELECT DISTINCT l_suppkey % 60 AS a, l_partkey % 90 AS b FROM lineitem), s AS (SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 END AS g FROM part)
SELECT 'p' || a AS caller, 'p' || b AS callee, CASE WHEN x.g <> y.g THEN true END AS crosses FROM p LEFT JOIN s x ON x.k = a LEFT JOIN s y ON y.k = b""")
def flow_tag(spark, d):
    name = lambda c: F.concat(F.lit("p"), c)
    fns = t(spark, d, "part").select(name("p_partkey").alias("name"), F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("g"), F.col("p_size") % 4)).otherwise("").alias("subsystem"))
    flows = t(spark, d, "lineitem").select(name(F.col("l_suppkey") % 60).alias("callerFn"), name(F.col("l_partkey") % 90).alias("calleeFn")).distinct().withColumn("crossSubsystem", F.lit(None).cast("boolean"))
    g = stitch.tag_flows(_graph(spark, functions=fns, flows=flows))
    return g.flows.select(F.col("callerFn").alias("caller"), F.col("calleeFn").alias("callee"), F.col("crossSubsystem").alias("crosses"))


@query("SELECT DISTINCT 'g' || p_size % 4 AS name FROM part WHERE p_size % 4 <> 0")
def subsystem_nodes(spark, d):
    fns = t(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("g"), F.col("p_size") % 4)).otherwise("").alias("subsystem"))
    return stitch.roll_up(_graph(spark, functions=fns)).subsystems


@query("""SELECT 'has_branch' AS kind, 'f' || user_id AS function, 'v' || event_id % 3 AS key FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'has_parameter', 'f' || user_id, CAST(event_id % 4 AS VARCHAR) FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def containment(spark, d):
    e, i = t(spark, d, "events"), F.col("event_id")
    name = F.concat(F.lit("f"), "user_id")
    fns = t(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("f"), "c_custkey").alias("name"))
    branches = e.select(name.alias("function"), F.concat(F.lit("v"), i % 3).alias("conditionLHS"), F.lit("==").alias("conditionOp"), i.alias("conditionRHSValue"))
    g = _graph(spark, functions=fns, branches=branches, parameters=e.select(name.alias("functionName"), (i % 4).cast("int").alias("position")))
    one = graph.has_branch(g).select(F.lit("has_branch").alias("kind"), "function", F.col("conditionLHS").alias("key"))
    return one.unionByName(graph.has_parameter(g).select(F.lit("has_parameter").alias("kind"), F.col("functionName").alias("function"), F.col("position").cast("string").alias("key")))


@query("SELECT event_type AS source, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, source LIMIT 15")
def constants_per_source(spark, d):
    return constants.per_source(t(spark, d, "events").select(F.col("event_type").alias("source")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS caller, 'h' || o_orderkey || '(b, a)' AS expression, CAST(2 AS INT) AS n, 'a,b' AS codes FROM orders WHERE o_orderkey % 3 <> 1""")
def extract_indirect_edges(spark, d):
    k = F.col("o_orderkey")
    args = F.array(F.struct(F.lit(2).alias("ord"), F.lit("b").alias("code")), F.struct(F.lit(1).alias("ord"), F.lit("a").alias("code")))
    calls = t(spark, d, "orders").select(
        k.cast("string").alias("caller"), F.concat(F.lit("h"), k, F.lit("(b, a)")).alias("code"), F.lit("a.c").alias("file"), F.lit(1).alias("line"), F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("callees"),
        F.when(k % 3 == 2, "<operator>.indirectCall").otherwise("x").alias("methodFullName"), args.alias("args"), k.alias("ord"),
    )
    return records.indirect_call_edges(calls).select(F.col("callerFn").alias("caller"), F.col("callExpression").alias("expression"), F.col("argCount").alias("n"), F.array_join("argCodes", ",").alias("codes"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS caller, 'h' || o_orderkey || '(x)' AS expression, 'a' || o_custkey % 4 || '.c' AS file, CAST(o_orderkey % 50 AS INT) AS line FROM orders WHERE o_orderkey % 3 <> 1""")
def extract_indirect_nodes(spark, d):
    k = F.col("o_orderkey")
    calls = t(spark, d, "orders").select(
        k.cast("string").alias("caller"), F.concat(F.lit("h"), k, F.lit("(x)")).alias("code"), F.concat(F.lit("a"), F.col("o_custkey") % 4, F.lit(".c")).alias("file"), (k % 50).cast("int").alias("line"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("callees"), F.when(k % 3 == 2, "<operator>.indirectCall").otherwise("x").alias("methodFullName"), k.alias("ord"),
    )
    return records.indirect_calls(calls).select(F.col("callerFunction").alias("caller"), F.col("callExpression").alias("expression"), "file", "line")


@query("""SELECT p_name AS name, p_type AS "fullName", CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS file, CAST(CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_size END AS INT) AS line, p_partkey % 5 = 0 AS "isExternal", p_partkey AS ord FROM part""")
def extract_functions(spark, d):
    k = F.col("p_partkey")
    methods = t(spark, d, "part").select(
        F.col("p_name").alias("name"), F.col("p_type").alias("fullName"), F.when(k % 5 != 0, F.col("p_brand")).alias("file"), F.when(k % 7 != 0, F.col("p_size")).alias("line"), F.lit("int()").alias("signature"), (k % 5 == 0).alias("isExternal"), k.alias("ord"),
    )
    return records.functions(methods).select("name", "fullName", "file", "line", "isExternal", "ord")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ops' WHEN 1 THEN 'tab' END AS struct, CASE event_id % 4 WHEN 0 THEN 'm' || user_id WHEN 1 THEN '[]' WHEN 2 THEN 'v' || user_id ELSE '*q' END AS field, CASE WHEN event_id % 4 = 1 THEN user_id END AS idx
FROM events WHERE event_type <> 'error'""")
def extract_runtime_assignments(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    kind = i % 4
    rows = t(spark, d, "events").select(
        F.when(kind == 0, "field").when(kind == 1, "slot").when(kind == 2, "variable").otherwise("deref").alias("place"), F.when(kind == 0, "ops").when(kind == 1, "tab").when(kind == 2, F.concat(F.lit("v"), u)).otherwise("q").alias("base"),
        F.when(kind == 0, F.concat(F.lit("m"), u)).alias("member"), F.when(kind == 1, u).alias("slot"), F.when(F.col("event_type") != "error", F.concat(F.lit("fn"), i)).alias("targetFn"), F.lit("a.c").alias("file"), F.lit(1).alias("line"), i.alias("ord"),
    )
    return records.runtime_assignments(rows).select(F.col("ord").alias("event_id"), F.col("structType").alias("struct"), F.col("fieldName").alias("field"), F.col("arrayIndex").alias("idx"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'CallEdge' ELSE 'IndirectCall' END AS type, CASE WHEN event_id % 3 = 0 THEN 'g' || user_id END AS callee,
CASE WHEN event_id % 3 = 1 THEN 'sk->m' || user_id || '()' WHEN event_id % 3 = 2 THEN '(*cb)()' END AS expression FROM events""")
def extract_compiler_calls(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    rows = t(spark, d, "events").select(
        F.lit("f").alias("callerFn"), F.when(i % 3 == 0, F.concat(F.lit("g"), u)).alias("calleeFn"), F.when(i % 3 == 2, "cb").alias("var"), F.when(i % 3 == 1, "sk").alias("obj"), F.when(i % 3 == 1, F.concat(F.lit("m"), u)).alias("field"), (i % 3 == 2).alias("deref"),
        F.lit("a.c").alias("file"), F.lit(1).alias("line"), F.lit(2).alias("argCount"), i.alias("ord"),
    )
    return records.compiler_calls(rows).select(F.col("ord").alias("event_id"), "type", F.col("calleeFn").alias("callee"), F.col("callExpr").alias("expression"))


# What a traversal looks up


@query("""WITH f AS (SELECT 't' || s_suppkey AS name FROM supplier WHERE s_acctbal > 0), r AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS x, 't' || o_orderkey % 120 AS target FROM orders WHERE o_orderstatus = 'F'),
i AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS x FROM orders)
SELECT CAST(i.c AS VARCHAR) AS caller, i.x AS expression, k.target AS target FROM i LEFT JOIN (SELECT * FROM r WHERE target IN (SELECT name FROM f)) k ON k.c = i.c AND k.x = i.x""")
def optional_expand(spark, d):
    o = t(spark, d, "orders")
    key = [F.col("o_custkey").cast("string"), F.col("o_orderpriority")]
    fns = t(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("t"), "s_suppkey").alias("name"))
    sites = o.select(key[0].alias("callerFn"), key[1].alias("callExpression")).distinct()
    resolves = o.where("o_orderstatus = 'F'").select(key[0].alias("callerFunction"), key[1].alias("callExpression"), F.concat(F.lit("t"), F.col("o_orderkey") % 120).alias("target"), F.lit(None).cast("long").alias("arrayIndex")).distinct()
    made = traverse.call_sites(_graph(spark, functions=fns, indirect_edges=sites, resolves=resolves))
    return made.select(F.col("callerFunction").alias("caller"), F.col("callExpression").alias("expression"), "target")


@query(f"""WITH p AS ({_POINTERS}), u AS (SELECT * FROM p WHERE target IN (SELECT 't' || s_suppkey FROM supplier WHERE s_acctbal > 0))
SELECT f AS field, idx, arg_min(target, (source <> 'gcc', ord)) AS target FROM u WHERE idx IS NOT NULL GROUP BY f, idx UNION ALL SELECT f, NULL, arg_min(target, (source <> 'gcc', ord)) FROM u GROUP BY f""")
def traversal_candidates(spark, d):
    fns = t(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("t"), "s_suppkey").alias("name"))
    by_slot, by_field = traverse.candidates(_graph(spark, functions=fns, fnptrs=_pointers(spark, d)))
    return by_slot.select(F.col("_field").alias("field"), F.col("_at").alias("idx"), F.col("_indexed").alias("target")).unionByName(by_field.select(F.col("_field").alias("field"), F.lit(None).cast("long").alias("idx"), F.col("_any").alias("target")))


@query(f"""WITH e AS ({_FLOWS}) SELECT a AS caller, b AS callee, string_agg(i || '>' || j, ' ' ORDER BY i, j) AS flows FROM e GROUP BY a, b""")
def traversal_flows(spark, d):
    made = traverse.passed_arguments(_flows(spark, d).withColumns({"calleeParamPos": F.coalesce("calleeParamPos", F.lit(-1)), "calleeParamName": F.lit(None).cast("string")}))
    text = F.array_join(F.transform("flows", lambda f: F.concat(f["from_pos"].cast("string"), F.lit(">"), f["to_pos"].cast("string"))), " ")
    return made.select(F.col("callerFn").alias("caller"), F.col("calleeFn").alias("callee"), text.alias("flows"))


@query(f"""WITH o AS (SELECT o_orderkey, 'm' || o_orderkey % 90 AS f, 'ops' || o_orderkey % 7 AS st, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 END AS idx FROM orders), p AS ({_POINTERS}),
r AS (SELECT *, source <> 'gcc' AS k FROM p), t1 AS (SELECT f, st, arg_min({{'t': target, 'i': idx}}, (k, ord)) AS h FROM r WHERE st IS NOT NULL GROUP BY f, st),
t2 AS (SELECT f, idx, arg_min({{'t': target, 'i': idx}}, (k, ord)) AS h FROM r WHERE idx IS NOT NULL GROUP BY f, idx), t3 AS (SELECT f, arg_min({{'t': target, 'i': idx}}, (k, ord)) AS h FROM r GROUP BY f)
SELECT CAST(o_orderkey AS VARCHAR) AS caller, coalesce(t1.h, t2.h, t3.h).t AS target, coalesce(t1.h, t2.h, t3.h).i AS "arrayIndex",
CASE WHEN t1.h IS NOT NULL THEN 'static_fnptr_typed' WHEN t2.h IS NOT NULL THEN 'static_fnptr_indexed' ELSE 'static_fnptr_fallback' END AS "resolvedBy"
FROM o LEFT JOIN t1 ON t1.f = o.f AND t1.st = o.st LEFT JOIN t2 ON t2.f = o.f AND t2.idx = o.idx JOIN t3 ON t3.f = o.f""")
def resolve_typed(spark, d):
    """All three ways to resolve a call, with structs known by their pointers' names."""
    k = F.col("o_orderkey")
    slot = F.when(k % 2 == 0, F.concat(F.lit("["), k % 9, F.lit("]"))).otherwise("")
    sites = t(spark, d, "orders").select(k.cast("string").alias("callerFunction"), F.concat(F.lit("s"), k % 7, slot, F.lit("->m"), k % 90, F.lit("(x)")).alias("callExpression"))
    known = F.create_map(*(x for i in range(7) for x in (F.lit(f"s{i}"), F.lit(f"ops{i}"))))
    made = stitch.resolutions(sites, _pointers(spark, d), known)
    return made.select(F.col("callerFunction").alias("caller"), "target", "arrayIndex", "resolvedBy")


@query(f"""WITH e AS ({_EDGES}) SELECT "callerFunction", "callExpression", "resolvedBy" FROM e WHERE "resolvedBy" = 'dynamic'
UNION ALL SELECT CAST(user_id AS VARCHAR), 'p->m' || event_id || '(x)', 'static_fnptr_fallback' FROM events WHERE event_type = 'purchase'""")
def resolve_again(spark, d):
    """Static resolutions are deleted and made anew, observed ones stay."""
    e = t(spark, d, "events").where("event_type = 'purchase'")
    expr = F.concat(F.lit("p->m"), "event_id", F.lit("(x)"))
    sites = e.select(F.col("user_id").cast("string").alias("callerFunction"), expr.alias("callExpression"), F.lit("unresolved").alias("state"))
    pointers = e.select(F.lit(None).cast("string").alias("structType"), F.concat(F.lit("m"), "event_id").alias("fieldName"), F.lit("fn").alias("targetFn"), F.lit(None).cast("long").alias("arrayIndex"), F.lit("gcc").alias("source"), F.col("event_id").alias("ord"))
    fns = spark.createDataFrame([("fn",)], "name string")
    old = _edges(spark, d).withColumn("arrayIndex", F.lit(None).cast("long"))
    g = stitch.resolve_indirect(_graph(spark, functions=fns, indirect_calls=sites, fnptrs=pointers, resolves=old))
    return g.resolves.select("callerFunction", "callExpression", "resolvedBy")


@query("""SELECT 'Function' AS "nodeType", 'n' || o_custkey AS name, o_orderstatus = 'O' AS ext, count(*) AS n FROM orders
WHERE NOT (o_orderstatus = 'O' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O')) GROUP BY ALL""")
def stub_merge(spark, d):
    """Stubs go where the function is known under its name."""
    nodes = t(spark, d, "orders").select(F.lit("Function").alias("nodeType"), F.concat(F.lit("n"), "o_custkey").alias("name"), (F.col("o_orderstatus") == "O").alias("isExternal"))
    kept, _ = stitch.merge_stubs(nodes, nodes.limit(0))
    return kept.groupBy("nodeType", "name", F.col("isExternal").alias("ext")).agg(F.count("*").alias("n"))


# More scalars


@query("""SELECT p_partkey, 'f' || p_size AS probed, CASE p_partkey % 3 WHEN 0 THEN 'ops' WHEN 1 THEN 'tab' END AS struct, CASE WHEN p_size > 9 THEN '%xx' || p_size || '%' ELSE '%' END AS wild FROM part""")
def scalar_fields(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    expr = F.when(k % 3 == 0, F.concat(F.lit("ops->f"), n, F.lit("->g(x)"))).when(k % 3 == 1, F.concat(F.lit("tab[3]->f"), n, F.lit("(x)"))).otherwise(F.concat(F.lit("f"), n, F.lit("(x)")))
    known = F.create_map(F.lit("tab"), F.lit("tab"), F.concat(F.lit("f"), n), F.lit("ops"))
    wild = S.like_field(F.when(n > 9, F.concat(F.lit("xx"), n)).otherwise("abc"))
    return t(spark, d, "part").select("p_partkey", S.probe_field_name(expr).alias("probed"), S.struct_type(expr, known).alias("struct"), wild.alias("wild"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type <> 'view' THEN 'stale' ELSE 'verified' END AS state, CAST(1000 + event_id AS BIGINT) AS "validUntil" FROM events WHERE event_type <> 'error'""")
def expire_edges(spark, d):
    i = F.col("event_id")
    edges = t(spark, d, "events").where("event_type <> 'error'").select(i.alias("event_id"), F.when(F.col("event_type") == "view", "static").otherwise("dynamic").alias("resolvedBy"), F.lit("verified").alias("state"), (1000 + i).alias("validUntil"))
    return obs.expire(edges, F.when(i % 2 == 0, 2000 + i).otherwise(F.lit(0)).cast("long")).select("event_id", "state", "validUntil")


@query(f"""WITH e AS ({_EDGES}), o AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS x, 't' || arg_max(event_id, event_id) % 7 AS hit FROM events WHERE value >= 20 GROUP BY user_id, event_type)
SELECT "callerFunction", "callExpression", target, "resolvedBy", state FROM e UNION ALL SELECT u, x, hit, 'dynamic', 'verified' FROM o WHERE (u, x) NOT IN (SELECT ("callerFunction", "callExpression") FROM e WHERE "resolvedBy" = 'dynamic')""")
def record_observed(spark, d):
    e = t(spark, d, "events").where("value >= 20")
    seen = e.select(F.col("user_id").cast("string").alias("caller_fn"), F.col("event_type").alias("call_site"), F.concat(F.lit("t"), F.col("event_id") % 7).alias("hit_fn"), F.col("event_id").alias("ts"))
    return obs.record_observations(_edges(spark, d), seen, F.lit(0).cast("long")).select("callerFunction", "callExpression", "target", "resolvedBy", "state")

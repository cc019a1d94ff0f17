"""Sources, validation, union and deduplication on files written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import constants, dedup, graph, records, subsystems
from plumbline.sources import records as src


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("units")
    call = lambda a, b, **k: {"type": "CallEdge", "callerFn": a, "calleeFn": b, "file": "a.c", "line": 1} | k
    files = {
        "b.json": [call("f", "g", line=9), call("f", "g", file="b.c"), {"type": "Odd"}, {"type": "BranchCondition", "function": "f", "conditionOp": "==", "conditionLHS": "x", "conditionRHSValue": "many"}],
        "a.json": [call("f", "g"), call("f", None), {"type": "BranchCondition", "function": "f", "conditionOp": "==", "conditionLHS": "x", "conditionRHSValue": 3, "lhsArgPos": 0}, {"type": "FnPtrAssignment", "fieldName": "init", "targetFn": "t", "sourceFile": "a.c", "arrayIndex": 1}, {"type": "IndirectCall", "callerFn": "f", "callExpr": "x->y()"}],
        "empty.json": [],
        "object.json": {"type": "CallEdge"},
        "nodes_x.json": [{"nodeType": "Function", "name": "f", "file": "net/a.c", "line": 3, "isExternal": False}, {"nodeType": "FnPtrAssignment", "fieldName": "init", "targetFn": "t", "arrayIndex": 1, "source": "joern"}],
        "edges_x.json": [{"edgeType": "CallEdge", "callerFn": "f", "calleeFn": "g", "file": "n.c", "line": 2, "source": "joern"}, {"edgeType": "IndirectCallEdge", "callerFn": "f", "callExpression": "x->init()", "argCodes": ["a"]}],
        "gcc_merged.json": [call("no", "no")],
    }
    for name, rows in files.items():
        (d / name).write_text(json.dumps(rows))
    (d / "broken.json").write_text('[{"type": "CallEdge", ')
    (d / "manifest.txt").write_text("/src/net/a.c\n\n  /src/net/b.c \n/src/mm/c.c\n/src/tools/t.c\n/src/Makefile\n/other/x.c\n/src/net/c.c\n/src/net/d.c\n")
    (d / "probe.txt").write_text("noise\nX_HIT:tcp_connect\nX_TIMEOUT\n")
    (d / "blank.txt").write_text("\n\n")
    inc = d / "include/uapi/linux"
    inc.mkdir(parents=True)
    (inc / "socket.h").write_text("#define AF_INET 2\n#define PF_INET AF_INET\nenum {\n A,\n B = 5, /* b */\n C,\n};\n")
    (inc / "zz.h").write_text("#define AF_INET 99\n#define ONE 1\n#define LOOP_A LOOP_B\n#define LOOP_B LOOP_A\n")
    return f"file://{d}"


def test_units(spark, folder):
    units, files = src.read_units(spark, folder)
    assert {(r.name, r.bad, r.n) for r in files.collect()} == {("a.json", False, 5), ("b.json", False, 4), ("empty.json", False, 0), ("object.json", True, 0), ("broken.json", True, 0)}
    fine, rejects = records.validated(units)
    assert {(r.reject_reason, r.type): r.n for r in rejects.collect()} == {("missing field", "CallEdge"): 1, ("unknown type", "Odd"): 1, ("unknown type", "IndirectCall"): 1, ("not a number", "BranchCondition"): 1}
    merged = records.merged_units(fine)
    assert sorted((r.callerFn, r.file, r.line) for r in merged.where("type = 'CallEdge'").collect()) == [("f", "a.c", 1), ("f", "b.c", 1)]
    nodes, edges = records.unified(src.read_nodes(spark, folder), src.read_edges(spark, folder), merged)
    n = nodes.collect()
    assert sorted(r.gid for r in n) == list(range(len(n)))
    assert {r.name: r.isExternal for r in n if r.nodeType == "Function"} == {"f": False, "g": True, "t": True}
    assert [r.source for r in n if r.nodeType == "FnPtrAssignment"] == ["gcc"]
    assert sorted((r.edgeType, r.source) for r in edges.collect()) == [("CallEdge", "gcc"), ("IndirectCallEdge", None)]
    g = graph.load(nodes, edges, spark.createDataFrame([("A", 1, "h", 0)], "name string, value long, source string, ord long"))
    assert {(r.name, r.subsystem) for r in g.functions.collect()} == {("f", "net"), ("g", None), ("t", None)}
    assert [(r.conditionRHSValue, r.conditionRHS, r.branchType) for r in g.branches.collect()] == [(3, "3", "if")]
    assert [(r.callerFn, r.calleeFn, r.resolvedBy) for r in g.calls.collect()] == [("f", "g", "gcc")]


def test_other_sources(spark, folder, tmp_path):
    m = src.read_manifest(spark, f"{folder}/manifest.txt")
    assert m.count() == 8
    with pytest.raises(ValueError):
        src.read_manifest(spark, f"{folder}/blank.txt")
    with pytest.raises(FileNotFoundError):
        src.read_nodes(spark, f"{folder}/include/uapi/linux")
    got = subsystems.subsystems(m, "/src").collect()
    assert [(r.path, r.n, r.examples) for r in got] == [("/src/mm", 1, ["mm/c.c"]), ("/src/net", 4, ["net/a.c", "net/b.c", "net/c.c"])]
    assert {r.reason: r.n for r in subsystems.skipped(m, "/src").collect()} == {"outside": 1, "no folder": 1, "excluded": 1}
    assert subsystems.largest(subsystems.subsystems(m, "/src", min_files=2)).first().key == "net"
    assert [r.hit_fn for r in src.read_observations(spark, f"{folder}/probe.txt").collect()] == ["tcp_connect", None]
    assert src.usable(src.whole_files(spark, folder, "a.json")).count() == 0
    src.write_json(m, f"file://{tmp_path}/j", ["path"])
    assert spark.read.json(f"file://{tmp_path}/j").count() == 8
    first = src.write_stage(m, f"file://{tmp_path}/s")
    assert src.write_stage(m.limit(0), f"file://{tmp_path}/s").count() == first.count() == 8
    assert src.write_stage(m.limit(0), f"file://{tmp_path}/s", force=True).count() == 0


def test_headers(spark, folder):
    lines = src.read_headers(spark, folder)
    made = {r.name: (r.value, r.source.rpartition("/")[2]) for r in constants.extract_constants(lines).collect()}
    assert made == {"AF_INET": (2, "socket.h"), "PF_INET": (2, "socket.h"), "A": (0, "socket.h"), "B": (5, "socket.h"), "C": (6, "socket.h"), "ONE": (1, "zz.h")}
    found = constants.extract_constants(lines)
    assert {r.name for r in constants.unresolved_aliases(lines, found).collect()} == {"LOOP_A", "LOOP_B"}
    assert constants.per_source(found).first().n == 5


#: Header texts and what they define, worked out by hand.
HEADERS = [
    # a counted entry, a literal before a shift, an octal one that is neither defined nor counted, a value in brackets
    ("enum a {\n A,\n B = 1 << 3,\n C,\n D = 0755,\n E,\n F = (1<<2),\n};\n#define A 9\n", {"A": 0, "B": 1, "C": 2, "E": 3, "F": 4}),
    # the line that opens a block ends none; entries on it, or on the line that ends it, don't count; what stands after it isn't in it
    ("#define X 1\nenum { P, Q }\nR,\n} z;\nenum q {\n {\n S,\nenum inner\n T }\nU,\n#define X 2\n", {"X": 1, "R": 0, "S": 0}),
    # a brace of its own, negative values, an empty and a lower-case line between, one entry a line
    ("typedef enum\n{\n G = -3,\n H,\n\n h,\n I, J,\n} t;\n#define K 0x10\n#define K 5\n", {"G": -3, "H": -2, "I": -1, "K": 16}),
    # blocks after each other: the second begins on a line with both marks, and counts anew; comments hide marks
    ("enum {\n A,\n};\nenum { } /* enum */\n B,\n C = 7,\n} // }\n#define D 2\nenum {\n E,\n F\n", {"A": 0, "B": 0, "C": 7, "D": 2, "E": 0, "F": 1}),
    # a closing brace without a block, an entry given twice: the last enum's value counts
    ("}\n#define M 3 /* three */\nenum {\n N = 4,\n};\nenum {\n N,\n O\n};\n", {"M": 3, "N": 0, "O": 1}),
]


def test_enums_and_definitions(spark):
    rows = [(f"h{i}", 0, n, line) for i, (text, _) in enumerate(HEADERS) for n, line in enumerate(text.split("\n"))]
    values, _ = constants.definitions(spark.createDataFrame(rows, "path string, header_rank int, line_no int, text string").repartition(3))
    got = {f"h{i}": {} for i in range(len(HEADERS))}
    for r in values.collect():
        got[r.path][r.name] = r.value
    assert got == {f"h{i}": want for i, (_, want) in enumerate(HEADERS)}


def test_producers(spark):
    calls = spark.createDataFrame([("f", "g", None, None, None, False, 0), ("f", None, "cb", None, None, True, 1), ("f", None, None, "sk", "m", False, 2), ("f", None, None, None, "m", None, 3), ("f", None, "x", None, None, False, 4)], "callerFn string, calleeFn string, var string, obj string, field string, deref boolean, ord long")
    made = records.compiler_calls(calls.selectExpr("*", "'a.c' AS file", "1 AS line", "0 AS argCount")).orderBy("ord").collect()
    assert [(r.type, r.calleeFn, r.callExpr) for r in made] == [("CallEdge", "g", None), ("IndirectCall", None, "(*cb)()"), ("IndirectCall", None, "sk->m()"), ("IndirectCall", None, "->m()"), ("IndirectCall", None, "<indirect_call>")]
    places = spark.createDataFrame([("field", "ops", "open", None, "f1", 0), ("slot", "tab", None, 3, "f2", 1), ("variable", "cb", None, None, "f3", 2), ("deref", "p", None, None, "f4", 3), ("field", "ops", "open", None, None, 4)], "place string, base string, member string, slot long, targetFn string, ord long")
    got = records.runtime_assignments(places.selectExpr("*", "'a.c' AS file", "1 AS line")).orderBy("ord").collect()
    assert [(r.structType, r.fieldName, r.arrayIndex, r.targetFn) for r in got] == [("ops", "open", None, "f1"), ("tab", "[]", 3, "f2"), (None, "cb", None, "f3"), (None, "*p", None, "f4")]
    methods = spark.createDataFrame([("f", None, None, None, None, None, 0)], "name string, fullName string, file string, line int, signature string, isExternal boolean, ord long")
    assert records.functions(methods).first().asDict() == {"nodeType": "Function", "name": "f", "fullName": "", "file": "", "line": -1, "signature": "", "isExternal": False, "source": "joern", "ord": 0}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 2 else f"n{i}") for i in range(50)], "id long, name string").repartition(5)
    src.write_json_array(rows, f"file://{tmp_path}/a", ["id"])
    parts = sorted(p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-"))
    made = [r for p in parts if p.read_text().strip() for r in json.loads(p.read_text())]
    assert [r["id"] for r in made] == list(range(50)) and "name" not in made[1] and made[0]["name"] == "n0"
    for part in (["/src/a.c", ""], ["/src/b.c"]):
        src.append_manifest(spark.createDataFrame([(p,) for p in part], "path string"), f"file://{tmp_path}/m")
    m = src.read_manifest(spark, f"file://{tmp_path}/m")
    assert sorted(r.path for r in m.collect()) == ["/src/a.c", "/src/b.c"]
    paths = spark.createDataFrame([("/src/net/ipv4/tcp.c",), ("/src/net/core/x.c",), ("/src/network/x.c",), ("/else/net/y.c",)], "path string")
    assert sorted(tuple(r) for r in subsystems.staged(paths, "/src", "net").collect()) == [("/src/net/core/x.c", "net_core_x.c"), ("/src/net/ipv4/tcp.c", "net_ipv4_tcp.c")]


def test_upserts(spark):
    rows = [("f", "", -1, True, 0), ("f", "a.c", 12, False, 1), ("f", "b.c", 13, False, 2), ("g", "", -1, False, 3), ("g", "", 7, True, 4)]
    nodes = spark.createDataFrame([("Function", n, f, l, e, i) for n, f, l, e, i in rows], "nodeType string, name string, file string, line int, isExternal boolean, ord long").repartition(3)
    assert sorted((r.name, r.file, r.line, r.isExternal) for r in graph.functions(nodes).collect()) == [("f", "a.c", 12, True), ("g", "", 7, False)]
    df = spark.createDataFrame([(None, 1, "x", 5), (None, 0, "y", 6), ("k", 2, "z", 7)], "k string, ord long, v string, w int")
    assert sorted((r.k or "", r.v) for r in dedup.first_wins(df, ["k"]).collect()) == [("", "y"), ("k", "z")]
    assert sorted((r.k or "", r.v) for r in dedup.trusted_first(df, ["k"], F.col("v") == "x").collect()) == [("", "x"), ("k", "z")]
    p = spark.createDataFrame([("FnPtrAssignment", "init", "t", i, s, o) for i, s, o in ((1, "joern", 0), (None, "gcc", 1), (2, "joern", 2))], "nodeType string, fieldName string, targetFn string, arrayIndex long, source string, ord long")
    assert [(r.arrayIndex, r.source) for r in graph.fnptrs(p).collect()] == [(2, "gcc")] and graph.fnptrs(p, "full").count() == 3


def test_aliases_and_chains(spark):
    copies = spark.createDataFrame([("v1", None, "sk", 0), ("v2", "v1", None, 1), ("v3", "v2", None, 2), ("v4", "v9", None, 3)], "version string, of string, name string, ord long")
    assert {r.version: r["name"] for r in records.alias_names(copies).collect()} == {"v1": "sk", "v2": "sk", "v3": "sk"}
    refs = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)] + [("a", "b"), ("b", "a")], "name string, ref string")
    made = constants.closure(refs, spark.createDataFrame([("n40", 7)], "name string, value long"))
    assert {r.name: r.value for r in made.collect()} == {f"n{i}": 7 for i in range(41)}
    assert schemas.merged("a int", "a int, b string") == "a int, b string"


def test_calls_through_pointers(spark):
    text = records.described_call(F.lit("v"), F.lit("o"), F.lit(None).cast("string"), F.lit(True))
    assert spark.range(1).select(text.alias("x")).first().x == "(*v)()"
    calls = spark.createDataFrame([("g", "a.c", 1, ["&h", "x"], True, 0)], "calleeFn string, file string, line int, args array<string>, indirect boolean, ord long")
    assert [(r.fieldName, r.targetFn, r.context) for r in records.argument_assignments(calls).collect()] == [("arg0", "h", "arg_to_indirect")]

"""The socket graph end to end: load, stitch, report, traverse, format."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.operators import report, stitch, traverse
from tests import fixtures


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('graph')}/g"
    G.load(*fixtures.records(spark)).save(path)
    return G.read_graph(spark, path)


@pytest.fixture(scope="module")
def whole(spark, raw, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('graph')}/s"
    stitch.stitch(raw).save(path)
    return G.read_graph(spark, path)


def steps(t):
    return [(r.seq, r.depth, r.function, r.via) for r in t.path.orderBy("seq").collect()]


def names(t):
    return [s[2] for s in steps(t)]


EXPECTED = [
    (0, 0, "__sys_socket", "syscall entry"),
    (1, 1, "sock_create", "direct call"),
    (2, 2, "__sock_create", "direct call"),
    (3, 3, "security_socket_create", "direct call [cross-subsystem]"),
    (4, 3, "inet_create", "fn_ptr: pf->create(net, sock, protocol, kern) [static_fnptr]"),
    (5, 4, "[UNRESOLVED] (*sk->sk_prot->hash)(sk)", "indirect — no target found"),
    (6, 4, "sk_alloc", "direct call"),
    (7, 4, "tcp_v4_init_sock", "fn_ptr: sk->sk_prot->init(sk) [static_fnptr]"),
]


LOST = "── Unresolved indirect call sites " + "─" * 36
PRETTY = [
    "═" * 70,
    "  socket(AF_INET=2, SOCK_STREAM=1, 0=0)",
    "═" * 70,
    "",
    "__sys_socket() {",
    "  sock_create() {",
    "    __sock_create() {",
    "      ✂  /* alt path pruned → sock_legacy */",
    "      security_socket_create();  /* cross-subsystem */",
    "      inet_create() {  /* fn_ptr → pf->create(net, sock, protocol, kern) [static] */",
    "        [UNRESOLVED] (*sk->sk_prot->hash)(sk)();  /* no target */",
    "        sk_alloc();",
    "        tcp_v4_init_sock();  /* fn_ptr → sk->sk_prot->init(sk) [static] */",
    "      }",
    "    }",
    "  }",
    "}",
    "",
    "── Pruned alternative paths " + "─" * 42,
    "  __sock_create() excluded:",
    "    ✂  sock_legacy()",
    "",
    LOST,
    "  ?  (*sk->sk_prot->hash)(sk)",
    "",
    "─" * 70,
    "  Steps: 8   Pruned: 1   Unresolved: 1",
    "─" * 70,
]
GRAPHED = [
    (0, "__sys_socket() {"), (1, "sock_create() {"), (2, "__sock_create() {"), (3, "/* ✂ alt path pruned → sock_legacy */"), (3, "security_socket_create();"),
    (3, "inet_create() {  /* fn_ptr → pf->create(net, sock, protocol, kern) [static] */"), (4, "(*sk->sk_prot->hash)(sk)();  /* UNRESOLVED */"), (4, "sk_alloc();"),
    (4, "tcp_v4_init_sock();  /* fn_ptr → sk->sk_prot->init(sk) [static] */"), (3, "}"), (2, "}"), (1, "}"), (0, "}"),
]


def test_load_and_stitch(whole):
    assert {r.name for r in G.bulk_caller_counts(whole.calls, 2).collect()} == {"kmalloc"}
    assert {r.name for r in whole.functions.where("orphan").collect()} == {"inet6_create", "lonely_fn", "tcp_v4_init_sock", "udp_init_sock"}
    assert [(r.callerFn, r.calleeFn) for r in whole.calls.where("crossSubsystem").collect()] == [("__sock_create", "security_socket_create")]
    assert [(r.src, r.dst) for r in whole.calls_into.collect()] == [("net", "security")]
    assert {(r.callExpression[:8], r.target, r.resolvedBy) for r in whole.resolves.collect()} == {("pf->crea", "inet_create", "static_fnptr_fallback"), ("sk->sk_p", "tcp_v4_init_sock", "static_fnptr_fallback")}
    h = report.health(whole).first()
    assert (h.functions, h.external, h.indirect, h.unresolved, h.resolved, h.orphans) == (12, 1, 3, 1, 2, 4)
    assert round(h.unresolved_pct, 1) == 33.3 and h.unresolved_alarm and not h.external_alarm and not h.ok
    assert report.health(whole, 60.0).first().ok
    s = report.status(whole).first()
    assert (s.functions, s.call_edges, s.indirect_calls, s.branch_points, s.constants, s.dynamic_edges) == (12, 9, 3, 1, 4, 0)
    assert G.check_unique(whole.functions, "name") and G.broken_keys(whole) == []
    assert G.broken_keys(whole.with_(functions=whole.functions.unionByName(whole.functions))) == ["functions"]
    assert G.has_branch(whole).count() == 1 and G.has_parameter(whole).count() == 0
    assert G.assigns(whole.fnptrs, whole.functions).count() == 4


def test_predict(whole):
    p = traverse.predict(whole, "socket(AF_INET, SOCK_STREAM, 0)", infra_threshold=2)
    assert p.entry == "__sys_socket"
    assert p.env == {"arg0": 2, "AF_INET": 2, "arg1": 1, "SOCK_STREAM": 1, "arg2": 0}
    assert steps(p.walk) == EXPECTED
    env = {r.function: r.resolved for r in p.walk.path.collect()}
    assert env["__sock_create"] == {"AF_INET": 2, "SOCK_STREAM": 1, "arg0": 2, "net": 2, "arg1": 2, "family": 2, "arg2": 1, "type": 1, "arg3": 0, "protocol": 0}
    assert [(r.depth, r.function) for r in p.walk.pruned.collect()] == [(3, "sock_legacy")]
    assert [r.expression for r in p.walk.unresolved.collect()] == ["(*sk->sk_prot->hash)(sk)"]
    assert report.pretty(p).split("\n") == PRETTY
    graphed = report.function_graph(p).split("\n")
    assert graphed[1:3] == ["  socket(AF_INET=2, SOCK_STREAM=1, 0=0)", "  function_graph trace  (static prediction)"]
    assert graphed[5:18] == ["  " * d + "|  " + x for d, x in GRAPHED]
    assert graphed[19:25] == [LOST, "  ?  (*sk->sk_prot->hash)(sk)", "", "── Pruned branches (argument-gated) " + "─" * 34, "  __sock_create() excluded:", "    ✂  sock_legacy()"]
    small = report.compact(p)
    assert "▶ __sys_socket()" in small and "inet_create()  ← fn_ptr" in small and "kmalloc" not in small and "\n  └─ sock_create" not in small
    made = json.loads(report.as_json(p))
    assert len(made["path"]) == 8 and made["prunedBranches"][0]["function"] == "sock_legacy"
    assert [r.leaf for r in report.with_leaves(p.walk.path).orderBy("seq").collect()] == [False, False, False, True, False, True, True, True]


def test_variants(raw, whole):
    tcp, udp = {"arg0": 2, "arg1": 1, "arg2": 0}, {"arg0": 2, "arg1": 2, "arg2": 0}
    walk = lambda g, env, **k: traverse.traverse(g, "__sys_socket", env, infra_threshold=2, **k)
    assert names(walk(whole, udp))[-1] == "tcp_v4_init_sock"
    got = steps(walk(raw, udp))
    assert got[-1][2] == "udp_init_sock" and got[-1][3].endswith("[graph]")
    for k in ({"max_steps": 3}, {"max_depth": 2}):
        t = walk(whole, tcp, **k)
        assert names(t) == ["__sys_socket", "sock_create", "__sock_create"]
        assert [r.function for r in t.pruned.collect()] == ["sock_legacy"]
    assert "sock_legacy" in names(walk(whole, {"arg0": 10, "arg1": 1, "arg2": 0}))


def test_observed(spark, whole):
    seen = spark.createDataFrame([("inet_create", "(*sk->sk_prot->hash)(sk)", "udp_init_sock", 1), ("inet_create", "(*sk->sk_prot->hash)(sk)", "lonely_fn", 2)], "caller_fn string, call_site string, hit_fn string, t int")
    t = traverse.traverse(whole, "__sys_socket", {"arg0": 2}, infra_threshold=2, observations=seen.withColumn("ts", F.timestamp_seconds("t")))
    assert ("lonely_fn", "fn_ptr: (*sk->sk_prot->hash)(sk) [dynamic]") in [(s[2], s[3]) for s in steps(t)]
    assert [r.expression for r in t.dynamic_hits.collect()] == ["(*sk->sk_prot->hash)(sk)"] and t.unresolved.count() == 0


def test_unknown_call(whole):
    with pytest.raises(LookupError):
        traverse.predict(whole, "nothing(1)")
    with pytest.raises(ValueError):
        traverse.predict(whole, "nothing")

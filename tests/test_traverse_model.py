"""The traversal on graphs whose paths were worked out by hand, and its rules as properties of random graphs."""

import random

from plumbline import schemas
from plumbline.operators import graph as G
from plumbline.operators.traverse import traverse


def graph_of(spark, names, calls=(), sites=(), pointers=(), resolved=(), tests=(), flows=()):
    """calls: caller, callee; sites: caller, expression; pointers: field, slot, target, source; resolved: caller, expression,
    target; tests: function, left side, comparison, value, label, argument; flows: caller, callee, from, to, parameter."""
    df = lambda rows, ddl: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ddl + ", ord bigint")
    return G.CodeGraph(
        functions=df([(n, False) for n in names], "name string, isExternal boolean"), parameters=df([], schemas.PARAMETER), constants=df([], schemas.CONSTANT),
        branches=df(tests, "function string, conditionLHS string, conditionOp string, conditionRHSValue bigint, conditionRHSLabel string, lhsArgPos int"),
        indirect_calls=df(sites, "callerFunction string, callExpression string"), fnptrs=df(pointers, "fieldName string, arrayIndex bigint, targetFn string, source string"),
        calls=df([(*c, False) for c in calls], "callerFn string, calleeFn string, crossSubsystem boolean"), flows=df(flows, "callerFn string, calleeFn string, callerArgPos int, calleeParamPos int, calleeParamName string"),
        indirect_edges=df(sites, "callerFn string, callExpression string"), assigns=df([], "x string"),
        resolves=spark.createDataFrame([(*r, "static_fnptr_fallback", None, None, None) for r in resolved], schemas.RESOLVES_TO),
    )


def walked(t):
    rows = t.path.orderBy("seq").collect()
    path = [(r.depth, r.function, r.via) for r in rows]
    assert [r.seq for r in rows] == list(range(len(path)))
    return path, [(r.depth, r.function) for r in t.pruned.orderBy("ord").collect()], [r.expression for r in t.unresolved.orderBy("ord").collect()]


E, D, LOST = "syscall entry", "direct call", "indirect — no target found"
CALLS = [("e", "a"), ("e", "b"), ("e", "hub"), ("a", "c"), ("a", "hub"), ("b", "c"), ("b", "hub"), ("c", "e")]
SMALL = {"names": ["e", "a", "b", "c", "d", "hub"], "calls": CALLS, "sites": [("a", "p->x(q)"), ("a", "p->y(q)")], "resolved": [("a", "p->x(q)", "d")], "tests": [("e", "v", "==", 1, "b", 0)]}


def test_small_graph(spark):
    g = graph_of(spark, **SMALL)
    a = [(0, "e", E), (1, "a", D), (2, "[UNRESOLVED] p->y(q)", LOST)]
    below = [(2, "c", D), (2, "d", "fn_ptr: p->x(q) [static_fnptr]")]
    # The branch to b holds for 1 alone; hub has more callers than two; c is first called by a; e is visited already.
    assert walked(traverse(g, "e", {"arg0": 0}, infra_threshold=2)) == ([*a, *below], [(1, "b")], ["p->y(q)"])
    assert walked(traverse(g, "e", {"arg0": 1}, infra_threshold=3))[0] == [*a, (1, "b", D), (1, "hub", D), *below]
    assert walked(traverse(g, "e", {}, infra_threshold=2)) == ([*a, (1, "b", D), *below], [], ["p->y(q)"])  # a branch that can't be told holds
    assert walked(traverse(g, "e", {"arg0": 1}, infra_threshold=2, max_depth=1))[0] == [*a, (1, "b", D)]
    # A step and what is unresolved in it come together, so that a path can end beyond its bound by these.
    assert walked(traverse(g, "e", {"arg0": 1}, infra_threshold=2, max_steps=2))[0] == a
    assert walked(traverse(g, "e", {"arg0": 1}, infra_threshold=2, max_steps=4))[0] == [*a, (1, "b", D)]


def test_slots_and_fields(spark):
    g = graph_of(spark, ["e", "f1", "f2", "f3"], sites=[("e", "tab[v]->run(x)")], pointers=[("run", 1, "f1", "joern"), ("run", 2, "f2", "joern"), ("run", 3, "f3", "gcc"), ("run", 2, "nobody", "gcc")])
    to = lambda env: walked(traverse(g, "e", env))[0][1:]
    how = "fn_ptr: tab[v]->run(x) [graph]"
    assert to({"v": 2}) == [(1, "f2", how)] and to({}) == [(1, "f3", how)]  # without a slot the compiler's goes first
    assert to({"v": 9}) == [(1, "[UNRESOLVED] tab[v]->run(x)", LOST)]
    twice = graph_of(spark, ["e", "a"], [("e", "a")], [("a", "p->back(x)")], [("back", None, "e", "gcc")])
    assert walked(traverse(twice, "e"))[0] == [(0, "e", E), (1, "a", D)]  # found, but visited already: neither a step nor unresolved


def test_arguments_on_their_way(spark):
    flows = [("e", "a", 0, 1, "kind"), ("a", "b", 1, 0, "type"), ("e", "c", 5, 0, "none")]
    g = graph_of(spark, ["e", "a", "b", "c"], [("e", "a"), ("e", "c"), ("a", "b")], flows=flows)
    env = {r.function: {k: v for k, v in r.resolved.items() if v is not None} for r in traverse(g, "e", {"arg0": 7, "flag": 3}).path.collect()}
    assert env == {"e": {"arg0": 7, "flag": 3}, "a": {"arg1": 7, "kind": 7, "flag": 3}, "b": {"arg0": 7, "type": 7, "kind": 7, "flag": 3}, "c": {"flag": 3}}


def test_a_wide_level_and_a_narrow_bound(spark):
    """Of a thousand callees those that the bound leaves room for are visited, the first by name."""
    names = [f"f{i:04d}" for i in range(1000)]
    t = traverse(graph_of(spark, ["e", *names], [("e", n) for n in names]), "e", {}, max_steps=10)
    assert [x[1] for x in walked(t)[0]] == ["e", *names[:9]]


def test_rules_on_random_graphs(spark):
    rng = random.Random(4)
    names = [f"f{i:02d}" for i in range(14)]
    calls = sorted({(rng.choice(names), rng.choice(names)) for _ in range(26)}) + [(n, "hub") for n in names[:6]]
    sites = sorted({(rng.choice(names), f"p->{rng.choice('abcd')}(x)") for _ in range(10)})
    resolved = [(*s, rng.choice([*names, "hub"])) for s in sites if s[1][3] == "d"]
    pointers = [(f, None, rng.choice(names), "gcc") for f in "abc"]
    tests = [(rng.choice(names), "v", "==", rng.randint(0, 1), rng.choice(names), 0) for _ in range(8)]
    g = graph_of(spark, [*names, "hub"], calls, sites, pointers, resolved, tests)
    t = traverse(g, "f00", {"arg0": 1}, infra_threshold=4)
    path, pruned, lost = walked(t)
    env = {r.function: r.resolved for r in t.path.collect()}
    steps = [p for p in path if p[2] != LOST]
    order = {fn: i for i, (_, fn, _) in enumerate(steps)}
    depth = {fn: d for d, fn, _ in steps}
    assert len(order) == len(steps) and [d for d, *_ in steps] == sorted(d for d, *_ in steps)
    cut = lambda a, b: any(x[0] == a and x[4] == b and env[a].get("arg0") not in (None, x[3]) for x in tests)
    static, field = {(r[0], r[1]): r[2] for r in resolved}, {}
    for f, _, to, _ in pointers:
        field.setdefault(f, to)
    for d, fn, via in steps[1:]:
        direct = [a for a, b in calls if b == fn and a in order and not cut(a, b)] if fn != "hub" else []
        by_pointer = [s[0] for s in sites if s[0] in order and (static.get(s) == fn and fn != "hub" or field.get(s[1][3]) == fn)]
        first = min([*direct, *by_pointer], key=order.get)
        assert depth[first] == d - 1 and (via != D or first in direct)
    assert "hub" not in order or any(f == "hub" for f in field.values())
    for d, fn in pruned:
        assert any(depth[a] == d - 1 and cut(a, b) for a, b in calls if b == fn and a in order)
    for expr in lost:
        assert expr[3] not in field and (1 + min(depth[c] for c, x in sites if x == expr and c in order), f"[UNRESOLVED] {expr}", LOST) in path
    reached = {"f00"} | {b for a, b in calls if a in order and b != "hub" and not cut(a, b)}
    assert reached <= set(order)


def test_order_path_goes_over_all_orders(spark, tmp_path):
    from plumbline.plans import catalogue

    spark.createDataFrame([(3, 9, "1-URGENT"), (2000, 3, "1-URGENT"), (70000, 2000, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.function for r in catalogue.bfs_order_path(spark, str(tmp_path)).orderBy("seq").collect()] == ["n3", "n2000", "n70000"]

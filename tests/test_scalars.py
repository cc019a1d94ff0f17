import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S


@pytest.fixture(scope="module")
def check(spark):
    def run(make, cases):
        """Each case: its arguments, then the result."""
        rows = spark.createDataFrame([(str(c[0]) if c[0] is not None else None,) for c in cases], "x string")
        got = [r.y for r in rows.coalesce(1).select(make(F.col("x")).alias("y")).collect()]
        assert got == [c[1] for c in cases]

    return run


def test_parse_call(check):
    check(lambda x: F.to_json(S.parse_call(x)), [("f(a,,b)", '{"name":"f","args":["a","b"]}'), ("f()", '{"name":"f","args":[]}'), (" f ( a\n, b ) ", '{"name":"f","args":["a","b"]}'), ("f", None), (None, None)])


def test_int_literal(check):
    check(S.int_literal, [("42", 42), ("0x2a", 42), ("-7", -7), ("0755", None), ("0", 0), ("00", 0), ("0o17", 15), ("0b101", 5), ("+3", 3), ("1U", None), ("", None), (None, None), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), ("0xffffffffffffffffff", None), (" 5 ", 5)])


def test_names_in_calls(check):
    check(S.field_name, [("sk->sk_prot->init(sk)", "init"), ("(*sk->sk_prot->connect)(sk)", None), ("cb(x)", "cb"), ("*cb(x)", "cb"), ("x", None)])
    check(S.probe_field_name, [("ops->create(sock)", "create"), ("net_families[2]->create", "create"), ("sk->sk_prot->connect", "sk_prot"), ("callback_fn(args)", "callback_fn")])
    check(S.literal_index, [("t[3]->f()", 3), ("t[i]->f()", None)])
    check(lambda x: S.struct_type(x), [("a->b->c(x)", None), ("ops->f()", None), ("f", None)])
    check(lambda x: S.struct_type(x, F.create_map(F.lit("ops"), F.lit("proto_ops"))), [("ops->f()", "proto_ops"), ("x->ops[2]->f()", "proto_ops"), ("q->f()", None)])


def test_branches(check):
    check(lambda x: F.concat_ws(" ", S.condition(x)["lhs"], S.condition(x)["op"], S.condition(x)["rhs"]), [("a >= b", "a >= b"), ("p->fam == X", "fam == X"), ("!x", "")])
    check(S.flip_op, [("<", ">"), (">=", "<="), ("==", "=="), ("!=", "!=")])


def test_paths(check):
    for depth, cases in ((1, [("net/ipv4/tcp.c", "net"), ("mm/slub.c", "mm"), ("init/main.c", "init"), ("Makefile", None), ("", None)]), (2, [("net/ipv4/tcp.c", "net/ipv4"), ("mm/slub.c", "mm")])):
        check(lambda x, n=depth: S.subsystem_key(x, n), cases)
    check(lambda x: S.make_relative(x, "/src/"), [("/src/a/b.c", "a/b.c"), ("/srcs/a.c", None), ("/other", None)])
    check(S.mangle, [("/a/b\\c", "_a_b_c")])
    check(lambda x: S.label(x, "/src"), [("/src/net/ipv4", "net_ipv4")])


def test_header_lines(check):
    check(S.strip_comments, [("a /* x */ b // c", "a  b "), ("/* open", "/* open")])
    check(lambda x: S.define_int(x)["value"], [("#define A 42", 42), (" # define A 0x1F /* c */", 31), ("#define a 1", None), ("#define A 1U", None), ("#define A 0755", None)])
    check(lambda x: S.define_alias(x)["ref"], [("#define PF_INET AF_INET", "AF_INET"), ("#define A 1", None)])


def test_others(check):
    check(S.bare_call_name, [("__x64_sys_socket", "socket"), ("sys_socket", "socket"), ("__socket", "socket"), ("socket", "socket"), ("__sys_x", "x")])
    check(S.like_field, [("init", "%init%"), ("ops", "%")])
    check(S.is_noise, [("kmalloc_node", True), ("before", True), ("tcp_connect", False)])
    check(lambda x: S.valid_until(F.lit(0)), [("x", 7 * 86400)])
    check(lambda x: S.percent(F.lit(1), F.length(x)), [("abcd", 25.0), ("", 0.0)])


def test_three_valued_branches(spark):
    env = F.create_map(F.lit("family"), F.lit(2).cast("long"), F.lit("arg1"), F.lit(7).cast("long"), F.lit("none"), F.lit(None).cast("long"))
    holds = lambda op, lhs, rhs, pos: S.branch_holds(F.lit(op), F.lit(lhs), F.lit(rhs).cast("long"), F.lit(pos), env)
    cases = [(("==", "family", 2, -1), True), (("==", "family", 10, -1), False), (("<", "x", 8, 1), True), (("<", "none", 8, 1), True), (("~", "family", 2, -1), None), (("==", "family", None, -1), None), (("==", "x", 1, -1), None), ((">", "", 6, 1), True)]
    row = spark.range(1).select(*(holds(*c).alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(row) == [w for _, w in cases]

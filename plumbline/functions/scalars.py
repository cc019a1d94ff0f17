"""Scalar functions as Column builders: everything stays in the JVM, no Python functions run on rows.

Word characters are ASCII letters, digits and the underscore. A null input gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that a verified observation holds.
TTL_DAYS = 7

# Names that carry no information in a compact path.
NOISE_PREFIXES = (
    "__builtin_", "_raw_", "refcount_", "atomic_", "this_cpu_",
    "READ_ONCE", "WRITE_ONCE", "unlikely", "likely", "IS_ERR", "PTR_ERR",
    "ERR_PTR", "BUILD_BUG", "WARN_", "BUG_", "pr_", "_printk",
    "spin_lock", "spin_unlock", "mutex_lock", "mutex_unlock",
    "rcu_read_lock", "rcu_read_unlock", "__rcu_read",
    "down_write", "up_write", "down_read", "up_read",
    "get_current", "current_", "jiffies", "kmalloc", "kfree", "kzalloc",
    "SOCK_INODE", "iput", "inode_", "alloc_inode", "new_inode",
)
NOISE_NAMES = ("before", "after", "check_net", "get_next_ino")


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """Group `n` of the first match, null where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, n))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def last_wins(entries: Column) -> Column:
    """A map from an array of (key, value) structs in which the last entry of a key counts."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


# Calls and arguments


def parse_call(expr: Column) -> Column:
    """`name(a, b)` as struct(name, args); empty arguments are dropped, so later ones move up; null if it is no call."""
    e = strip(expr)
    pattern = r"(?s)^(\w+)\s*\((.*)\)\s*$"
    args = F.filter(F.transform(F.split(F.regexp_extract(e, pattern, 2), ","), strip), lambda a: a != "")
    return F.when(e.rlike(pattern), F.struct(F.regexp_extract(e, pattern, 1).alias("name"), args.alias("args")))


def int_literal(text: Column) -> Column:
    """A decimal, 0x, 0o or 0b literal with an optional sign; a leading zero and what exceeds 64 bits give null."""
    return F.when(text.rlike(r"^-?(0|[1-9][0-9]*)$"), text.try_cast("bigint")).otherwise(_any_literal(text))


def _any_literal(text: Column) -> Column:
    t = F.lower(strip(text))
    sign = F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(t, r"^[+-]", "")
    based = F.lit(None).cast("string")
    for mark, digits, base in (("0x", "[0-9a-f]+", 16), ("0o", "[0-7]+", 8), ("0b", "[01]+", 2)):
        # Longer than 64 bits of digits: conv would stop at its largest value.
        based = F.when(body.rlike(f"^{mark}{digits}$") & (F.length(F.regexp_replace(body, f"^{mark}0*", "")) <= {16: 16, 8: 21, 2: 64}[base]), F.conv(F.substring(body, 3, 100), base, 10)).otherwise(based)
    number = F.when(body.rlike(r"^(0+|[1-9][0-9]*)$"), body).otherwise(based)
    return F.concat(sign, number).try_cast("bigint")


def resolve_args(args: Column, constants: Column) -> Column:
    """Map arg0, arg1, ... to values: literals; names in `constants` (map), which also bind themselves; else null."""
    entries = F.flatten(
        F.transform(
            args,
            lambda a, i: F.when(
                int_literal(a).isNull() & F.coalesce(F.map_contains_key(constants, a), F.lit(False)),
                F.array(_entry(_arg(i), constants[a]), _entry(a, constants[a])),
            ).otherwise(F.array(_entry(_arg(i), int_literal(a)))),
        )
    )
    return last_wins(entries)


def _arg(i: Column) -> Column:
    return F.concat(F.lit("arg"), i.cast("string"))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.cast("bigint").alias("value"))


def propagate(env: Column, flows: Column) -> Column:
    """The callee's arguments from the caller's `env` (map) and `flows` (array of from_pos, to_pos, param).

    Positions are copied where the caller has a value; the caller's names that don't begin with "arg" are carried where
    nothing was copied; a parameter that the caller knows by name takes that value, with its position.
    """
    fine = F.filter(flows, lambda f: (f["from_pos"] >= 0) & (f["to_pos"] >= 0) & env[_arg(f["from_pos"])].isNotNull())
    copied = F.flatten(F.transform(fine, lambda f: F.array(_entry(_arg(f["to_pos"]), env[_arg(f["from_pos"])]), _entry(f["param"], env[_arg(f["from_pos"])]))))
    copied = F.filter(copied, lambda e: e["key"] != "")
    taken = F.transform(copied, lambda e: e["key"])
    carried = F.filter(F.transform(F.map_entries(env), lambda e: _entry(e["key"], e["value"])), lambda e: ~e["key"].startswith("arg") & ~F.array_contains(taken, e["key"]))
    known = F.filter(flows, lambda f: (f["param"] != "") & F.map_contains_key(env, f["param"]))
    named = F.flatten(F.transform(known, lambda f: F.array(_entry(f["param"], env[f["param"]]), _entry(_arg(f["to_pos"]), env[f["param"]]))))
    return last_wins(F.concat(copied, carried, named))


# Branches


def flip_op(op: Column) -> Column:
    """The comparison with its sides exchanged."""
    return F.when(op == "<", ">").when(op == ">", "<").when(op == "<=", ">=").when(op == ">=", "<=").otherwise(op)


def compare(op: Column, left: Column, right: Column) -> Column:
    """Three-valued: null for an unknown operator or a null side."""
    return F.when(op == "==", left == right).when(op == "!=", left != right).when(op == "<", left < right).when(op == "<=", left <= right).when(op == ">", left > right).when(op == ">=", left >= right)


def branch_holds(op: Column, lhs: Column, rhs_value: Column, arg_pos: Column, env: Column) -> Column:
    """A branch under the arguments: the left side by name, else by its position if that is not negative."""
    by_place = F.when(F.coalesce(arg_pos, F.lit(-1)) >= 0, env[_arg(arg_pos)])
    return compare(op, F.coalesce(F.when(lhs != "", env[lhs]), by_place), rhs_value)


def condition(text: Column) -> Column:
    """The first comparison of two words: struct(lhs, op, rhs), null if there is none."""
    p = r"(\w+)\s*(==|!=|<=|>=|<|>)\s*(\w+)"
    return F.when(text.rlike(p), F.struct(*(F.regexp_extract(text, p, n).alias(c) for c, n in (("lhs", 1), ("op", 2), ("rhs", 3)))))


# Call expressions


def field_name(expr: Column) -> Column:
    """The member that is called, `->name(`, else the name a call begins with."""
    return F.coalesce(group(expr, r"->(\w+)\s*\("), group(expr, r"^\*?(\w+)\s*\("))


def probe_field_name(expr: Column) -> Column:
    """As field_name, but for the first arrow, called or not."""
    return F.coalesce(group(expr, r"->(\w+)\s*[\(\[]?"), group(expr, r"^\*?(\w+)\s*\("))


def literal_index(expr: Column) -> Column:
    return group(expr, r"\[(\d+)\]").try_cast("bigint")


def match_index(expr: Column, env: Column, graph_index: Column) -> Column:
    """The array slot of a call: a bound variable in brackets, a literal one, the socket type for protocol tables, the graph's."""
    typed = F.when(expr.contains("sk_prot") | expr.contains("->prot->"), env["type"])
    return F.coalesce(env[group(expr, r"\[(\w+)\]")], literal_index(expr), typed, graph_index)


def struct_type(expr: Column, known: Column | None = None) -> Column:
    """The struct whose member an expression calls, by its pointer's name in `known` (map); without one always null."""
    pointer = group(expr, r"(\w+)(?:\[[^\]]*\])?\s*->\s*\w+\s*\(")
    return F.lit(None).cast("string") if known is None else known[pointer]


# Paths and names


def make_relative(path: Column, root: str) -> Column:
    """The path below `root`, by whole components; null outside."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 2**31 - 1)).when(path == root.rstrip("/"), ".")


def subsystem_key(path: Column, depth: int = 1) -> Column:
    """The first `depth` folders of a relative path; null for a file at the top and for an empty path."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/"))


def mangle(path: Column) -> Column:
    """A path as a file name."""
    return F.translate(path, "/\\", "__")


def label(path: Column, root: str) -> Column:
    return F.translate(F.coalesce(make_relative(path, root), path), "/", "_")


def bare_call_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^((__x64_|__arm64_|__)?sys_|__)", "")


def like_field(field: Column) -> Column:
    """A LIKE pattern for functions that may implement a field: around long names, any for short ones."""
    return F.when(F.length(field) > 3, F.concat(F.lit("%"), field, F.lit("%"))).otherwise("%")


def is_noise(name: Column) -> Column:
    out = name.isin(*NOISE_NAMES)
    for p in NOISE_PREFIXES:
        out = out | name.startswith(p)
    return out


def entry_candidates(name: Column) -> Column:
    """Names under which a call's entry function may be known, the best first."""
    return F.array(*(F.concat(F.lit(p), name) for p in ("sys_", "__sys_", "__x64_sys_", "__arm64_sys_", "")))


# Header lines


def strip_comments(line: Column) -> Column:
    """Without comments that end on the line."""
    return F.regexp_replace(F.regexp_replace(line, r"/\*.*?\*/", ""), r"//.*", "")


# What a line of a header has to look like.
DEFINE_INT = r"^\s*#\s*define\s+([A-Z_][A-Z0-9_]*)\s+(0[xX][0-9a-fA-F]+|-?\d+)\s*(?:/\*.*\*/)?\s*$"
DEFINE_ALIAS = r"^\s*#\s*define\s+([A-Z_][A-Z0-9_]*)\s+([A-Z_][A-Z0-9_]*)\s*$"
ENUM_ENTRY = r"^\s*([A-Z_][A-Z0-9_]*)(?:\s*=\s*(0[xX][0-9a-fA-F]+|-?\d+)\s*,?)?"


def header_literal(text: Column) -> Column:
    """int_literal of what the patterns above take for one: hexadecimal digits, or decimal ones with a sign."""
    digits = F.regexp_replace(text, "^0[xX]0*", "")
    hexadecimal = F.when(F.length(digits) <= 16, F.conv(F.concat(F.lit("0"), digits), 16, 10).try_cast("bigint"))
    return F.when(text.rlike("^0[xX]"), hexadecimal).when(text.rlike("^-?(0+|[1-9][0-9]*)$"), text.try_cast("bigint"))


def define_int(line: Column) -> Column:
    """A line that defines a name as an integer literal: struct(name, value)."""
    return F.when(line.rlike(DEFINE_INT), F.struct(F.regexp_extract(line, DEFINE_INT, 1).alias("name"), header_literal(F.regexp_extract(line, DEFINE_INT, 2)).alias("value")))


def define_alias(line: Column) -> Column:
    """A line that defines a name as another: struct(name, ref)."""
    return F.when(line.rlike(DEFINE_ALIAS), F.struct(F.regexp_extract(line, DEFINE_ALIAS, 1).alias("name"), F.regexp_extract(line, DEFINE_ALIAS, 2).alias("ref")))


def enum_parts(line: Column) -> dict[str, Column]:
    """A line of an enum block: name, and the literal it is given; each is empty where there is none."""
    return {"name": F.regexp_extract(line, ENUM_ENTRY, 1), "literal": F.regexp_extract(line, ENUM_ENTRY, 2)}


# Numbers


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def valid_until(now: Column, days: int = TTL_DAYS) -> Column:
    """Epoch seconds."""
    return now + F.lit(days * 86400)

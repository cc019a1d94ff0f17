"""The small socket graph that is worked out by hand."""

from plumbline import schemas

FUNCTIONS = [
    ("__sys_socket", "net/socket.c", False), ("sock_create", "net/socket.c", False), ("__sock_create", "net/socket.c", False), ("security_socket_create", "security/security.c", False),
    ("sock_legacy", "net/socket.c", False), ("inet_create", "net/ipv4/af_inet.c", False), ("inet6_create", "net/ipv6/af_inet6.c", False), ("sk_alloc", "net/core/sock.c", False),
    ("tcp_v4_init_sock", "net/ipv4/tcp_ipv4.c", False), ("udp_init_sock", "net/ipv4/udp.c", False), ("kmalloc", "", True), ("lonely_fn", "net/core/dev.c", False),
]
CALLS = [
    ("__sys_socket", "kmalloc"), ("__sys_socket", "sock_create"), ("sock_create", "__sock_create"), ("__sock_create", "kmalloc"), ("__sock_create", "security_socket_create"),
    ("__sock_create", "sock_legacy"), ("inet_create", "kmalloc"), ("inet_create", "sk_alloc"), ("sk_alloc", "inet_create"),
]
FLOWS = [("__sys_socket", "sock_create", i, i, p) for i, p in enumerate(("family", "type", "protocol"))] + [("sock_create", "__sock_create", i, i, p) for i, p in enumerate(("net", "family", "type", "protocol"))]
SITES = [("__sock_create", "pf->create(net, sock, protocol, kern)"), ("inet_create", "sk->sk_prot->init(sk)"), ("inet_create", "(*sk->sk_prot->hash)(sk)")]
POINTERS = [("create", 2, "inet_create"), ("create", 10, "inet6_create"), ("init", 1, "tcp_v4_init_sock"), ("init", 2, "udp_init_sock")]
CONSTANTS = [("AF_INET", 2), ("AF_INET6", 10), ("SOCK_STREAM", 1), ("SOCK_DGRAM", 2)]


def records(spark):
    """nodes, edges and constants as read from files."""
    nodes, edges = [], []
    for n, f, e in FUNCTIONS:
        nodes.append({"nodeType": "Function", "name": n, "fullName": n, "file": f, "line": 1, "isExternal": e})
    nodes.append({"nodeType": "BranchCondition", "function": "__sock_create", "conditionLHS": "family", "conditionOp": "==", "conditionRHSValue": 10, "conditionRHSLabel": "sock_legacy", "lhsArgPos": 1, "source": "gcc"})
    for f, x in SITES:
        nodes.append({"nodeType": "IndirectCall", "callerFunction": f, "callExpression": x})
        edges.append({"edgeType": "IndirectCallEdge", "callerFn": f, "callExpression": x, "argCount": 1})
    for f, i, t in POINTERS:
        nodes.append({"nodeType": "FnPtrAssignment", "fieldName": f, "arrayIndex": i, "targetFn": t, "source": "gcc"})
    edges += [{"edgeType": "CallEdge", "callerFn": a, "calleeFn": b, "source": "joern"} for a, b in CALLS]
    edges += [{"edgeType": "DataFlowEdge", "callerFn": a, "calleeFn": b, "callerArgPos": i, "calleeParamPos": j, "calleeParamName": p} for a, b, i, j, p in FLOWS]
    frame = lambda rows, ddl: spark.createDataFrame([r | {"ord": i} for i, r in enumerate(rows)], ddl + ", ord bigint")
    from pyspark.sql.types import StructType

    def full(rows, kind, ddl):
        names = [f.name for f in StructType.fromDDL(ddl).fields]
        return frame([{n: r.get(n) for n in [kind, *names]} for r in rows], f"{kind} string, {ddl}")

    return (
        full(nodes, "nodeType", schemas.merged(*schemas.NODES.values())),
        full(edges, "edgeType", schemas.merged(*schemas.EDGES.values())),
        spark.createDataFrame([(n, v, "h", i) for i, (n, v) in enumerate(CONSTANTS)], "name string, value bigint, source string, ord bigint"),
    )


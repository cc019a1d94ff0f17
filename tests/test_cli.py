import json

from plumbline import cli
from tests import fixtures


def test_build_predict_query(spark, tmp_path, capsys):
    nodes, edges, _ = fixtures.records(spark)
    strip = lambda r: {k: v for k, v in r.asDict().items() if v is not None and k != "ord"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/nodes_net.json").write_text(json.dumps([strip(r) for r in nodes.orderBy("ord").collect()]))
    (tmp_path / "in/edges_net.json").write_text(json.dumps([strip(r) for r in edges.orderBy("ord").collect()]))
    (tmp_path / "in/unit.json").write_text("[]")
    inc = tmp_path / "src/include/uapi/linux"
    inc.mkdir(parents=True)
    (inc / "socket.h").write_text("".join(f"#define {n} {v}\n" for n, v in fixtures.CONSTANTS))
    (tmp_path / "manifest").write_text("/src/net/socket.c\n")
    to = f"file://{tmp_path}/graph"
    cli.main(["build", f"file://{tmp_path}/in", "--headers", f"file://{tmp_path}/src", "--manifest", f"file://{tmp_path}/manifest", "--root", "/src", "--out", to])
    assert "/src/net" in capsys.readouterr().out
    cli.main(["predict", to, "socket(AF_INET, SOCK_STREAM, 0)", "--infra-threshold", "2", "--format", "json"])
    made = json.loads(capsys.readouterr().out.strip().split("\n", 0)[0])
    assert [s["function"] for s in made["path"]][:3] == ["__sys_socket", "sock_create", "__sock_create"] and len(made["path"]) == 8
    cli.main(["query", to, "SELECT count(*) AS n FROM calls WHERE crossSubsystem"])
    assert json.loads(capsys.readouterr().out) == {"n": 1}
    cli.main(["status", to])
    assert "functions" in capsys.readouterr().out
    site, ddl = "(*sk->sk_prot->hash)(sk)", "caller_fn string, call_site string, hit_fn string, ts int"
    spark.createDataFrame([("inet_create", site, "udp_init_sock", 1)], ddl).write.parquet(f"{to}/seen")
    cli.main(["predict", to, "socket(AF_INET, SOCK_STREAM, 0)", "--infra-threshold", "2", "--format", "json", "--observations", f"{to}/seen"])
    made = json.loads(capsys.readouterr().out)
    assert made["dynamicHits"] == [site] and "udp_init_sock" in [s["function"] for s in made["path"]]
    edges = lambda: [(r.callExpression, r.target, r.state) for r in spark.read.parquet(f"{to}/resolves").where("resolvedBy = 'dynamic'").collect()]
    n = spark.read.parquet(f"{to}/resolves").count()
    cli.main(["observe", to, f"{to}/seen"])
    cli.main(["observe", to, f"{to}/seen"])
    assert edges() == [(site, "udp_init_sock", "verified")] and spark.read.parquet(f"{to}/resolves").count() == n + 1
    # What was seen since replaces what was known; without --all an edge that still holds is left alone.
    spark.createDataFrame([("inet_create", site, "lonely_fn", 2)], ddl).write.parquet(f"{to}/later")
    cli.main(["checkup", to, f"{to}/later"])
    assert edges() == [(site, "udp_init_sock", "verified")]
    cli.main(["checkup", to, f"{to}/later", "--all"])
    assert edges() == [(site, "lonely_fn", "verified")] and "verified" in capsys.readouterr().out
    spark.createDataFrame([], ddl).write.parquet(f"{to}/none")
    cli.main(["checkup", to, f"{to}/none", "--all"])
    assert edges() == [(site, "lonely_fn", "stale")]


def test_build_again_exports_and_alarms(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    fn = lambda name, **k: {"nodeType": "Function", "name": name, "file": "net/a.c", "isExternal": False} | k
    nodes = [fn("f"), fn("g", isExternal=True, file=""), fn("g", line=9), {"nodeType": "IndirectCall", "callerFunction": "f", "callExpression": "p->x(q)"}]
    (tmp_path / "in/nodes_a.json").write_text(json.dumps(nodes))
    (tmp_path / "in/edges_a.json").write_text(json.dumps([{"edgeType": "CallEdge", "callerFn": "f", "calleeFn": "g"}]))
    (tmp_path / "in/unit.json").write_text(json.dumps([{"type": "CallEdge", "callerFn": "f", "calleeFn": "h", "file": "a.c"}]))
    (tmp_path / "manifest").write_text("/src/net/a.c\n")
    to, out = f"file://{tmp_path}/graph", f"file://{tmp_path}/out"
    argv = ["build", f"file://{tmp_path}/in", "--out", to, "--manifest", f"file://{tmp_path}/manifest", "--root", "/src", "--subsystems", f"{out}/subsystems", "--export", out, "--max-unresolved", "50"]
    assert cli.main(argv) == 1  # the only call through a pointer is unresolved
    known = {r.name: r.isExternal for r in spark.read.parquet(f"{to}/functions").collect()}
    assert known == {"f": False, "g": False, "h": True}  # a stub gives way to the function of its name
    read = lambda name: [r for p in sorted((tmp_path / f"out/{name}").glob("part-*")) if p.read_text().strip() for r in json.loads(p.read_text())]
    assert [r["name"] for r in read("nodes_all") if r["nodeType"] == "Function"] == ["f", "g", "h"] and len(read("edges_all")) == 2 and len(read("gcc_merged")) == 1
    assert [r.value for r in spark.read.text(f"{out}/subsystems").collect()] == ["/src/net"]
    # A stage that is there whole isn't made again.
    (tmp_path / "in/nodes_b.json").write_text(json.dumps([fn("new")]))
    cli.main(argv)
    assert spark.read.parquet(f"{to}/functions").count() == 3
    # Made anew, without the pass that merges stubs, and without the unit's file, which is too small to be whole.
    cli.main([*argv, "--force", "--max-unresolved", "100", "--passes", "0", "--min-bytes", "1000"])
    assert {r.name: r.isExternal for r in spark.read.parquet(f"{to}/functions").collect()} == {"f": False, "g": True, "new": False}
    assert spark.read.parquet(f"{to}/calls").count() == 1
    capsys.readouterr()
    assert cli.main([*argv, "--dry-run"]) == 0 and "Function" in capsys.readouterr().out

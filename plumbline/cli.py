"""Commands over a graph's folder: build, predict, query, status, observe, checkup.

    python -m plumbline.cli build RECORDS --manifest FILE --headers ROOT --out GRAPH
    python -m plumbline.cli predict GRAPH 'socket(AF_INET, SOCK_STREAM, 0)' --format pretty --observations SEEN
    python -m plumbline.cli query GRAPH 'SELECT count(*) FROM calls'
    python -m plumbline.cli status GRAPH
    python -m plumbline.cli observe GRAPH SEEN
    python -m plumbline.cli checkup GRAPH SEEN

A build's stages are written beside the graph, and one that is there whole isn't made again unless --force is given. The
exit code is 1 where the graph is built but one of its alarms is raised.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import constants, graph, records, report, stitch, subsystems, traverse
from plumbline.sources import records as sources
from plumbline.sources.shared import replace_table
from plumbline.streaming import observations as obs

FORMATS = {"pretty": report.pretty, "ftrace": report.function_graph, "compact": report.compact, "json": report.as_json}


def build(spark: SparkSession, a: argparse.Namespace) -> int:
    units, files = sources.read_units(spark, a.records, a.min_bytes)
    merged = records.merged_units(records.validated(units)[0])
    nodes, edges = records.unified(sources.read_nodes(spark, a.records), sources.read_edges(spark, a.records), merged)
    if a.passes is None or a.passes > 0:  # the first pass; names are unique once the graph is loaded
        nodes, edges = stitch.merge_stubs(nodes, edges)
    lines = sources.read_headers(spark, a.headers) if a.headers else spark.createDataFrame([], "path string, header_rank int, line_no int, text string")
    if a.dry_run:
        files.groupBy("bad").count().show()
        nodes.groupBy("nodeType").count().show()
        edges.groupBy("edgeType").count().show()
        return 0
    stage = lambda df, name: sources.write_stage(df, f"{a.out}.stages/{name}", a.force)
    nodes, edges = stage(nodes, "nodes"), stage(edges, "edges")
    found = stage(constants.extract_constants(lines), "constants")
    if a.export:
        sources.write_json_array(nodes, f"{a.export}/nodes_all", ["gid"])
        sources.write_json_array(edges, f"{a.export}/edges_all", ["ord"])
        sources.write_json_array(found, f"{a.export}/constants", ["name"])
        sources.write_json_array(merged, f"{a.export}/gcc_merged", ["ord"])
    # A constant has one value by now, so that any order will do.
    made = graph.load(nodes, edges, found.withColumn("ord", F.lit(0).cast("long")), a.root)
    loaded = graph.CodeGraph(**{name: stage(df, f"loaded/{name}") for name, df in made.frames().items()})
    if broken := graph.broken_keys(loaded):
        raise ValueError(f"keys that don't identify rows: {broken}")
    stitch.stitch(loaded, None if a.passes is None else max(0, a.passes - 1)).save(a.out)
    health = report.health(graph.read_graph(spark, a.out), a.max_unresolved).first()
    print("\n".join(f"{name:<18}{value}" for name, value in health.asDict().items()))
    if a.manifest:
        listed = subsystems.subsystems(sources.read_manifest(spark, a.manifest), a.root, a.depth, a.min_files)
        listed.show(truncate=False)
        if a.subsystems:
            listed.select("path").write.mode("overwrite").text(a.subsystems)
    return 0 if health.ok else 1


def _seen(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Observations: caller_fn, call_site, hit_fn, ts."""
    return spark.read.parquet(path) if path else None


def _now() -> Column:
    return F.lit(int(time.time())).cast("long")


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    how = {"max_depth": a.max_depth, "max_steps": a.max_steps, "infra_threshold": a.infra_threshold, "prefer_indexed": a.prefer_indexed}
    p = traverse.predict(graph.read_graph(spark, a.graph), a.call, observations=_seen(spark, a.observations), **how)
    print(FORMATS[a.format](p))


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    graph.read_graph(spark, a.graph).views()
    for row in spark.sql(a.sql).toJSON().take(a.limit):
        print(row)


def status(spark: SparkSession, a: argparse.Namespace) -> None:
    report.status(graph.read_graph(spark, a.graph)).show(vertical=True)


def observe(spark: SparkSession, a: argparse.Namespace) -> None:
    """Add an edge for each call site that was observed and has no such edge yet."""
    g = graph.read_graph(spark, a.graph)
    replace_table(spark, obs.record_observations(g.resolves, _seen(spark, a.observations), _now()), f"{a.graph}/resolves")


def checkup(spark: SparkSession, a: argparse.Namespace) -> None:
    """Edges past their time become stale, with --all every observed one; those that were seen again are verified."""
    g = graph.read_graph(spark, a.graph)
    old = obs.mark_stale(g.resolves) if a.all else obs.expire(g.resolves, _now())
    new = obs.checkup(old, _seen(spark, a.observations), _now())
    obs.checkup_counts(old, new).show()
    replace_table(spark, new, f"{a.graph}/resolves")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("records")
    b.add_argument("--out", required=True)
    b.add_argument("--headers")
    b.add_argument("--manifest")
    b.add_argument("--root", default="")
    b.add_argument("--depth", type=int, default=1)
    b.add_argument("--min-files", type=int, default=1)
    b.add_argument("--passes", type=int)
    b.add_argument("--max-unresolved", type=float, default=30.0)
    b.add_argument("--min-bytes", type=int, default=0, help="unit files that are smaller are no whole inputs")
    b.add_argument("--export", help="a folder for the records as JSON arrays")
    b.add_argument("--subsystems", help="a folder for the list of subsystems")
    b.add_argument("--force", action="store_true", help="make every stage again")
    b.add_argument("--dry-run", action="store_true")
    q = sub.add_parser("predict")
    q.add_argument("graph")
    q.add_argument("call")
    q.add_argument("--format", choices=FORMATS, default="pretty")
    q.add_argument("--max-depth", type=int, default=30)
    q.add_argument("--max-steps", type=int, default=500)
    q.add_argument("--infra-threshold", type=int, default=20)
    q.add_argument("--prefer-indexed", action="store_true")
    q.add_argument("--observations", help="a table of what probes saw: caller_fn, call_site, hit_fn, ts")
    s = sub.add_parser("query")
    s.add_argument("graph")
    s.add_argument("sql")
    s.add_argument("--limit", type=int, default=1000)
    sub.add_parser("status").add_argument("graph")
    o = sub.add_parser("observe")
    c = sub.add_parser("checkup")
    for x in (o, c):
        x.add_argument("graph")
        x.add_argument("observations")
    c.add_argument("--all", action="store_true")
    a = p.parse_args(argv)
    run = {"build": build, "predict": predict, "query": query, "status": status, "observe": observe, "checkup": checkup}[a.command]
    return run(SparkSession.builder.getOrCreate(), a) or 0


if __name__ == "__main__":
    sys.exit(main())

"""Constants from header lines: definitions, aliases and enums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.dedup import first_wins
from plumbline.sources.shared import Scratch


def _blocks(lines: DataFrame) -> DataFrame:
    """`lines` (path, line_no, clean) with start, the line that opened the enum a line is in, and edge.

    A line with `enum` opens a block unless one is open; a line with `}` closes one. start is null outside; the lines that
    open and close a block are edges of it. After a line with one of the marks the state is known; a line with both turns
    it round; so it follows from the last line with one mark and the number of those with both since. One sort by path.
    """
    opens, closes = F.col("clean").rlike(r"\benum\b"), F.col("clean").contains("}")
    w = Window.partitionBy("path").orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"_one": F.when(opens != closes, opens), "_both": (opens & closes).cast("int")})
    counted = marked.withColumn("_turns", F.sum("_both").over(so_far))
    base = F.last(F.when(F.col("_one").isNotNull(), F.struct("_one", "_turns")), ignorenulls=True).over(so_far)
    state = counted.withColumn("_base", base)
    turned = (F.col("_turns") - F.coalesce("_base._turns", F.lit(0))) % 2 == 1
    state = state.withColumn("_after", F.coalesce("_base._one", F.lit(False)) != turned)
    state = state.withColumn("_before", F.lag("_after", 1, False).over(w))
    inside = F.col("_before") | F.col("_after")
    start = F.last(F.when(F.col("_after") & ~F.col("_before"), F.col("line_no")), ignorenulls=True).over(so_far)
    out = state.withColumn("start", F.when(inside, start)).withColumn("edge", inside & (F.col("_before") != F.col("_after")))
    return out.drop("_one", "_both", "_turns", "_base", "_after", "_before")


def definitions(lines: DataFrame, strict_c: bool = False) -> tuple[DataFrame, DataFrame]:
    """header_line rows -> values (path, header_rank, name, value) and aliases (path, header_rank, line_no, name, ref).

    In a file an enum's value goes before a definition's, the last enum's before others, the first definition's before
    others. An enum entry without a literal counts on from the entry before; an octal literal is neither emitted nor
    counted. With strict_c an entry whose value isn't a plain literal has no value rather than a counted one.
    """
    clean = lines.withColumn("clean", S.strip_comments(F.col("text")))
    placed = _blocks(clean)
    no = F.col("line_no")
    entry = S.enum_parts(F.col("clean"))
    inside = placed.where("start IS NOT NULL AND NOT edge").select("path", "header_rank", "line_no", "start", "clean", *(c.alias(k) for k, c in entry.items())).where("name <> ''")
    inside = inside.withColumn("value", F.when(F.col("literal") != "", S.header_literal(F.col("literal"))))
    counted = inside.where("literal = '' OR value IS NOT NULL")
    if strict_c:
        counted = counted.where((F.col("literal") != "") | ~F.col("clean").contains("="))
    w = Window.partitionBy("path", "start").orderBy("line_no")
    counted = counted.withColumn("rn", F.row_number().over(w))
    base = F.last(F.col("value") - F.col("rn"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    enums = counted.select("path", "header_rank", "name", (F.coalesce(base, F.lit(-1)) + F.col("rn")).alias("value"), F.lit(0).alias("kind"), (-no).alias("at"))
    outside = placed.where("start IS NULL")
    d = outside.withColumn("d", S.define_int(F.col("clean"))).where("d.value IS NOT NULL").select("path", "header_rank", "d.name", "d.value", F.lit(1).alias("kind"), no.alias("at"))
    values = first_wins(enums.unionByName(d), ["path", "header_rank", "name"], ["kind", "at"]).select("path", "header_rank", "name", "value")
    number = S.define_int(F.col("clean")).isNull()
    aliases = outside.where(number).withColumn("a", S.define_alias(F.col("clean"))).where("a IS NOT NULL").select("path", "header_rank", "line_no", "a.name", "a.ref")
    return values, aliases


def closure(refs: DataFrame, base: DataFrame, rounds: int | None = None) -> DataFrame:
    """name, value of `base` (name, value) and of every name in `refs` (name, ref) whose references end there.

    Each round gives names whose reference has a value that value, and lets the others refer to their reference's
    reference, so a chain takes a number of rounds that grows with the logarithm of its length. A chain without an end,
    and a cycle, have no value. A name in `base` keeps its value.
    """
    spark = refs.sparkSession
    scratch = Scratch(spark, "closure")
    known = scratch.keep(base.select("name", "value"))
    open_ = scratch.keep(refs.select("name", "ref").join(known.select("name"), "name", "left_anti").dropDuplicates(["name"]))
    n, was = 0, None
    while (left := open_.count()) and left != was and (rounds is None or n < rounds):
        n, was = n + 1, left
        k = known.select(F.col("name").alias("ref"), "value")
        nxt = open_.select(F.col("name").alias("ref"), F.col("ref").alias("further"))
        looked = scratch.keep(open_.join(k, "ref", "left").join(nxt, "ref", "left"))
        known = scratch.keep(known.unionByName(looked.where("value IS NOT NULL").select("name", "value")))
        open_ = scratch.keep(looked.where("value IS NULL AND further IS NOT NULL").select("name", F.col("further").alias("ref")))
    return known


def extract_constants(lines: DataFrame, strict_c: bool = False) -> DataFrame:
    """name, value, source: the first header's definition wins, by rank, then path; aliases follow to their values."""
    values, aliases = definitions(lines, strict_c)
    found = first_wins(values, ["name"], ["header_rank", "path"]).select("name", "value", F.col("path").alias("source"))
    refs = first_wins(aliases, ["name"], ["header_rank", "path", -F.col("line_no")]).select("name", "ref", "path")
    every = closure(refs, found)
    origin = found.select("name", "source").unionByName(refs.join(found, "name", "left_anti").select("name", F.col("path").alias("source")))
    return every.join(origin, "name").select("name", "value", "source")


def unresolved_aliases(lines: DataFrame, constants: DataFrame) -> DataFrame:
    """Aliases that end nowhere."""
    return definitions(lines)[1].select("name", "ref").distinct().join(constants.select("name"), "name", "left_anti")


def per_source(constants: DataFrame, n: int = 15) -> DataFrame:
    """The headers with most constants."""
    return constants.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(n)

"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target in words; a document is taken target / size-of-its-source times in the mean: the whole part of
that number surely, the rest by a balanced sample. The cube method moves the fractional inclusion probabilities of a
source along directions that leave its expected words and its expected documents as they are, until each is 0 or 1. Three
units always have such a direction, so a block walks through its units with three in hand and ends with two at most.
Blocks are of bounded size; what they leave over meets again in fewer blocks, until one block of a source is left and at
most two of its units land by a single draw, after which one exchange in that block brings the words nearest to the target.

Rows that are alike in id, source and size are one unit with a count: of m such rows the whole part of m times the
probability is taken surely, and one fractional unit remains. Everything follows from hashes of the rows' values, so
reruns agree however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, table, text_bytes, text_chunks, whole_groups
from plumbline.llm.words import INK

WEIGHTS, SHARE, MOST = (3, 1, 2), (3, 2), 2
BLOCK, MERGE, SEED = 4096, 2048, 7
_EPS = 1e-9


def sizes(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The columns `keep` and size: the number of words (runs of anything but space, tab to carriage return); null has 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, text="_text"):
            counts = _starts(*text_bytes(b.column("_text")))
            made = b.select([c for c in b.schema.names if c != "_text"])
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array(counts, pa.int64())], [*made.schema.names, "size"])

    read = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "_text")
    return read.mapInArrow(count, f"{kinds}, size long")


def size_of(text: Column) -> Column:
    """The number of words of a text, as in sizes(); only the text goes to Python and only the count comes back."""

    @F.arrow_udf("long")
    def count(a: pa.Array) -> pa.Array:
        parts = [_starts(*text_bytes(b.column("text"))) for b in text_chunks(iter([pa.RecordBatch.from_arrays([a], ["text"])]))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return count(text)


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words begin in each text."""
    begins = INK[data]
    blank = np.ones(len(data), bool)
    blank[1:] = ~begins[:-1]
    blank[offsets[offsets < len(data)]] = True
    total = np.concatenate([[0], np.cumsum(begins & blank)])
    return total[offsets[1:]] - total[offsets[:-1]]


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """source, rows, source_size, target.

    Sources in order of their code points, null last, take the weights in turn and share share[0] / share[1] of all
    words by weight. A target stops at `most` times its source's words and the excess is shared again: targets are the
    smaller of that bound and weight times one level, and the level makes them add up. Per-source totals are the only
    rows that meet in one task.
    """
    num, den = share
    if not 0 < num <= most * den:
        raise ValueError("the share can't be met")
    by = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod(turn, F.lit(len(weights))) + 1))
    by = by.withColumn("bound", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    all_ = Window.partitionBy()
    level = (num * F.sum("source_size").over(all_) - den * before) / (den * left)
    by = by.withColumn("at", F.row_number().over(order)).withColumn("level", level)
    found = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("at"))).over(all_)
    # Where the share is all there is, rounding can leave no level below its ratio: then all targets are at their bounds.
    target = F.least(F.col("bound").cast("double"), F.coalesce(found * F.col("weight"), F.col("bound").cast("double")))
    return by.select("source", "rows", "source_size", target.alias("target"))


def flight(pi: np.ndarray, x: np.ndarray, draw) -> np.ndarray:
    """Move probabilities `pi` until two at most are fractional, keeping sum(pi) and sum(pi * x)."""
    p, size = pi.tolist(), x.tolist()
    hand: list[int] = []
    for i in range(len(p) + 1):
        if i < len(p):
            if _EPS < p[i] < 1 - _EPS:
                hand.append(i)
            else:
                p[i] = round(p[i])
        while len(hand) == 3 or i == len(p) and len(hand) == 2 and size[hand[0]] == size[hand[1]]:
            if len(hand) == 3:
                a, b, c = (size[j] for j in hand)
                u = (b - c, c - a, a - b) if a != b or b != c else (1, -1, 0)
            else:
                u = (1, -1)
            up = min((1 - p[j]) / d if d > 0 else p[j] / -d for j, d in zip(hand, u, strict=True) if d)
            down = min(p[j] / d if d > 0 else (1 - p[j]) / -d for j, d in zip(hand, u, strict=True) if d)
            step = up if draw() * (up + down) < down else -down
            for j, d in zip(hand, u, strict=True):
                p[j] += step * d
                if p[j] <= _EPS or p[j] >= 1 - _EPS:
                    p[j] = round(p[j])
            hand = [j for j in hand if 0 < p[j] < 1]
    return np.array(p, float)


def land(pi: np.ndarray, draw) -> np.ndarray:
    """Round what a flight leaves, two units at most, by one draw; both go up or down together as seldom as can be."""
    out, rest, u = pi.copy(), np.flatnonzero((pi > 0) & (pi < 1)), draw()
    for k, i in enumerate(rest):
        out[i] = u < pi[i] if k == 0 else u >= 1 - pi[i]
    return out


def settle(taken: np.ndarray, x: np.ndarray, over: float) -> np.ndarray:
    """Exchange one taken unit for one that isn't, if that brings the words, `over` too many, nearer to their total."""
    ins, outs = np.flatnonzero(taken == 0), np.flatnonzero(taken == 1)
    if len(ins) and len(outs):
        ins = ins[np.argsort(x[ins], kind="stable")]
        want = x[outs] - over  # the size that would be right in its place
        k = np.searchsorted(x[ins], want)
        pairs = [(np.abs(x[ins[j]] - want), j) for j in (np.clip(k - 1, 0, len(ins) - 1), np.clip(k, 0, len(ins) - 1))]
        off, j = min(pairs, key=lambda q: q[0].min())
        best = int(np.argmin(off))
        if off[best] < abs(over):
            taken[outs[best]], taken[ins[j[best]]] = 0, 1
    return taken


def _fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "g"):
        g, n = t["g"].to_numpy(), t.num_rows
        source = t["source"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero((np.diff(g, prepend=g[0]) != 0) | (np.diff(source, prepend=source[0]) != 0)).tolist(), n]
        pi, x, parts = t["pi"].to_numpy(), t["size"].to_numpy(), t["parts"].to_numpy()
        out = np.empty(n)
        for a, b in zip([0, *cuts], cuts, strict=False):
            if b > a:
                draw = np.random.default_rng(int(g[a]) & (2**63 - 1)).random
                out[a:b] = flight(pi[a:b], x[a:b], draw)
                if parts[a] == 1:
                    out[a:b] = settle(landed := land(out[a:b], draw), x[a:b], float((landed - pi[a:b]) @ x[a:b]))
        yield from t.set_column(t.schema.get_field_index("pi"), "pi", pa.array(out)).to_batches()


def mix(sized: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, block: int = BLOCK, merge: int = MERGE, seed: int = SEED) -> DataFrame:
    """A row for each distinct (doc_id, source, size): how often its `rows` rows are taken.

    Each row is taken `whole` times; the first `more` rows once more, and the next one too if `hit` is 1.
    """
    targets = scratch.keep(source_targets(sized, weights, share, most))
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("same"))
    named = units.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select("u.*", "rows", "source_size", "target")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = named.withColumn("whole", F.floor(f)).withColumn("pi", (f - F.floor(f)) * F.col("same"))
    named = named.withColumn("more", F.floor(F.col("pi") + _EPS)).withColumn("pi", F.greatest(F.lit(0.0), F.col("pi") - F.col("more")))
    parts = F.ceil(F.col("rows") / block)
    named = named.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), parts)).drop("rows")
    done = None
    while True:
        g = F.xxhash64(F.lit(seed), "source", "part", "parts")
        dealt = named.withColumn("g", g).repartition("g").sortWithinPartitions("g", "source", F.desc("size"), F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        flown = scratch.keep(dealt.mapInArrow(_fly, dealt.schema).drop("g"))
        open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
        made = flown.where(~open_)
        done = made if done is None else done.unionByName(made)
        named = flown.where(open_)
        if named.isEmpty():
            return done.select("doc_id", "source", "size", "same", "source_size", "target", "whole", "more", F.col("pi").cast("int").alias("hit"))
        named = named.withColumn("part", F.floor(F.col("part") / merge)).withColumn("parts", F.ceil(F.col("parts") / merge))


def _times(i: Column) -> Column:
    return F.col("whole") + F.when((i < F.col("more")) | ((i == F.col("more")) & (F.col("hit") == 1)), 1).otherwise(0)


def _numbered(units: DataFrame) -> DataFrame:
    """A row with its place i for each of the `same` rows of a unit, which may be a large part of all rows.

    They are dealt out in stretches, so no array is longer than one and no task has all rows of a unit.
    """
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1, F.lit(BLOCK).cast("long")))
    dealt = units.withColumn("begin", begin).repartition("doc_id", "begin")
    i = F.explode(F.sequence(F.col("begin"), F.least(F.col("same"), F.col("begin") + BLOCK) - 1))
    return dealt.withColumn("i", i).drop("begin")


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken, source, times.

    times (0 to `most`) says how often the mix takes the row, taken = times * size. A null text has size 0; null is a
    source of its own, the last. Rows of a source without words have target 0. Repeated rows are taken each for itself.
    Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(sizes(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")), "text", "doc_id", "source"))
    rows = _numbered(mix(sized, scratch, **how))
    times = _times(F.col("i"))
    return rows.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), "source", times.alias("times"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """`docs` with its own columns, each row as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mix")
    own = {c: f"_own_{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    sized = renamed.select("*", F.col(own[doc_id]).alias("doc_id"), F.col(own[source]).cast("string").alias("source"), size_of(F.col(own[text])).alias("size"))
    units = scratch.keep(mix(scratch.keep(sized.select("doc_id", "source", "size")), scratch, **how))
    i = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64(own[text]))) - 1
    left, right = sized.withColumn("i", i).alias("l"), units.alias("r")
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.size") == F.col("r.size"))
    times = _times(F.col("i"))
    out = left.join(right, on).where(times > 0).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))))
    return out.select(*(F.col(n).alias(c) for c, n in own.items()))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("source", "times")

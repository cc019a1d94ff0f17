"""SimHash near-duplicate detection with bit-sliced comparison.

A text's fingerprint has a bit set where over half of its word shingles' hashes have it. Fingerprints within a radius of
each other are linked, and linked texts form components.

Candidates come from the pigeonhole principle: of `radius + keep` blocks of bits, `keep` are equal in any two
fingerprints within the radius, so each distinct fingerprint goes into one bucket for every choice of `keep` blocks.
Within a bucket the bits are stored as vertical planes, 64 fingerprints to a word. A shift of the planes lays every
fingerprint against a later one, and two carry-save counters add up the differing bits of all lanes at once; words whose
lanes have all gone beyond the radius are left out of what follows. A bucket returns links to the smallest
fingerprint of each of its own components, not all pairs. Buckets over a bound are dealt again by parts of the
remaining bits, on the same principle, until they are small.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, table, text_bytes, text_chunks, whole_groups
from plumbline.llm.words import INK, find_words

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Blocks beyond the radius that must be equal. Two of five blocks make keys of 25 or 26 bits, ten for each fingerprint.
KEEP = 2
#: Fingerprints of a bucket that are compared at once; larger buckets are dealt again.
BUCKET = 1024
#: How often a bucket is dealt again before its blocks are compared with each other.
REFINE = 3
_CHUNK = 1_000_000
_WORD = 64


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of every row.

    A-Z become lower case; words are runs of anything but space, tab to carriage return; `shingle` consecutive words,
    joined by spaces, repeats included, are hashed by XXH64; fewer words make one shingle. Null, empty and blank texts
    have fingerprint 0.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xxh = xxhash.xxh64_intdigest
        for b in text_chunks(batches, most=_CHUNK):
            w = find_words(*text_bytes(b.column("text")), INK)
            # The words with one space after each, so that a shingle is a slice.
            size = w.end - w.start + 1
            at = np.concatenate([[0], np.cumsum(size)])
            step = np.ones(int(at[-1]), np.int64)
            if len(size):
                step[0] = w.start[0]
                step[at[1:-1]] = w.start[1:] - w.end[:-1]
            joined = w.low[np.minimum(np.cumsum(step), len(w.low) - 1)]
            joined[at[1:] - 1] = 0x20
            joined = joined.tobytes()
            first = np.concatenate([[0], np.cumsum(w.n)])
            out = np.zeros(len(w.n), np.uint64)
            for t, n in enumerate(w.n.tolist()):
                if n:
                    lo, m = first[t], max(1, n - shingle + 1)
                    begin, end = at[lo : lo + m].tolist(), (at[lo + min(n, shingle) : lo + min(n, shingle) + m] - 1).tolist()
                    h = np.array([xxh(joined[x:y], seed) for x, y in zip(begin, end, strict=True)], np.uint64)
                    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
                    out[t] = np.packbits(2 * bits.sum(0, dtype=np.int64) > m, bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(of, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, fp long")


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Bit planes: word j of plane b holds bit b of fingerprints 64 j to 64 j + 63. One more word of zeros follows."""
    n = -(-len(fp) // _WORD) * _WORD
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(fp)] = np.unpackbits(fp.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return np.concatenate([planes, np.zeros((64, 1), np.uint64)], axis=1)


def _lanes(flags: np.ndarray) -> np.ndarray:
    full = np.zeros(-(-len(flags) // _WORD) * _WORD, np.uint8)
    full[: len(flags)] = flags
    return np.packbits(full, bitorder="little").view(np.uint64)


def links_at(planes: np.ndarray, wanted: np.ndarray, shift: int, radius: int = RADIUS) -> np.ndarray:
    """The wanted lanes i whose fingerprint is within the radius of that of lane i + shift."""
    q, r = divmod(shift, _WORD)
    words = np.flatnonzero(wanted)
    over = ~wanted[words]
    counters = [np.zeros(len(words), np.uint64) for _ in range(int(radius).bit_length())]
    last = planes.shape[1] - 1
    for b in range(64):
        p = planes[b]
        near = p[np.minimum(words + q, last)]
        if r:
            near = (near >> np.uint64(r)) | (p[np.minimum(words + q + 1, last)] << np.uint64(_WORD - r))
        carry = p[words] ^ near
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if b % 8 == 7:
            alive = over != np.uint64(2**64 - 1)
            if np.count_nonzero(alive) < 0.7 * len(words):
                words, over, counters = words[alive], over[alive], [c[alive] for c in counters]
                if not len(words):
                    break
    # Lanes that never carried out hold their count in the counters; compare it with the radius from the top bit down.
    more, equal = np.zeros(len(words), np.uint64), np.full(len(words), 2**64 - 1, np.uint64)
    for i, c in reversed(list(enumerate(counters))):
        if radius >> i & 1:
            equal = equal & c
        else:
            more, equal = more | (equal & c), equal & ~c
    hit = ~(over | more)
    lanes = np.unpackbits(hit.view(np.uint8), bitorder="little").reshape(-1, _WORD)
    w, lane = np.nonzero(lanes)
    return words[w] * _WORD + lane


class Forest:
    """Components of what is linked so far, by the position of the smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.held: list[np.ndarray] = []
        self.size = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append(np.stack([a, b]))
            self.size += len(a)
            if self.size > 500_000:
                self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            a, b = np.concatenate(self.held, axis=1)
            label = self.label
            while True:
                x, y = label[a], label[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(nxt := label[label], label):
                    label = nxt
            self.label, self.held, self.size = label, [], 0
        return self.label


def bucket_links(group: np.ndarray, fp: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest of its component) in buckets given in order of `group`, fingerprints ascending in each.

    side: if given, only fingerprints of different sides are compared.
    """
    forest, planes = Forest(len(fp)), planes_of(fp)
    most = int(np.bincount(np.unique(group, return_inverse=True)[1]).max(initial=0))
    for shift in range(1, most):
        same = np.zeros(len(fp), bool)
        same[:-shift] = group[:-shift] == group[shift:]
        if side is not None:
            same[:-shift] &= side[:-shift] != side[shift:]
        i = links_at(planes, _lanes(same), shift, radius)
        forest.link(i, i + shift)
    label = forest.settle()
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets in order of g, then fp, with side: the links in each."""
    for t in whole_groups(batches, "g"):
        g = t["g"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        fp, side = t["fp"].to_numpy().view(np.uint64), t["side"].to_numpy()
        count = np.bincount(g)
        keep = np.flatnonzero(count[g] > 1)
        g, fp, side = g[keep], fp[keep], side[keep]
        order = np.argsort(count[g], kind="stable")  # buckets of like size together: short ones end early
        edges = np.flatnonzero(np.diff(g[order], prepend=-1))
        cuts = [*edges[:: max(1, len(edges) * 20_000 // max(1, len(order)))], len(order)] if len(order) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = order[a:b]
            u, v = bucket_links(g[at], fp[at], side[at] if (side[at] != 0).any() else None)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def masks(radius: int = RADIUS, keep: int = KEEP) -> list[int]:
    """The bit masks of every choice of `keep` out of radius + keep blocks."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(64), radius + keep)]
    return [sum(c) for c in combinations(blocks, keep)]


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """`mask` with each of radius + 1 parts of the remaining bits: one part is equal in fingerprints within the radius."""
    rest = np.array([b for b in range(64) if not mask >> b & 1])
    return [mask | sum(1 << int(b) for b in part) for part in np.array_split(rest, radius + 1) if len(part)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(fps: DataFrame, by: Column) -> DataFrame:
    """A row for each mask: m, key (the bits under the mask) and fp."""
    return fps.select("fp", F.explode(by).alias("m")).select("m", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")


def links(fps: DataFrame, scratch: Scratch, bucket: int = BUCKET, refine: int = REFINE, radius: int = RADIUS, keep: int = KEEP) -> DataFrame:
    """Links u > v (in unsigned order of their buckets) that connect what is within the radius among distinct fingerprints."""
    level = masks(radius, keep)
    rows = _dealt(fps, F.array(*(F.lit(_long(m)) for m in level)))
    found = []
    for step in range(refine + 1):
        hot = scratch.keep(rows.groupBy("m", "key").count().where(F.col("count") > bucket))
        some = not hot.isEmpty()
        cold = rows.join(hot, ["m", "key"], "left_anti") if some else rows
        g = F.xxhash64("m", "key")
        found.append(cold.select(g.alias("g"), "fp", F.lit(0).alias("side")))
        if not some:
            break
        full = rows.join(hot, ["m", "key"])
        if step < refine:
            nxt = {m: finer(m, radius) for m in level}
            by = F.create_map(*(x for m, f in nxt.items() for x in (F.lit(_long(m)), F.array(*(F.lit(_long(y)) for y in f)))))
            level = sorted({y for f in nxt.values() for y in f})
            rows = scratch.keep(_dealt(full.select("fp", by[F.col("m")].alias("by")), F.col("by")).distinct())
        else:  # blocks of the bucket against each other
            n = F.ceil(F.col("count") / (bucket // 2)).cast("int")
            own = F.pmod(F.xxhash64("fp"), n).cast("int")
            both = full.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
            pair = F.xxhash64("m", "key", F.least("own", "other"), F.greatest("own", "other"))
            found.append(both.select(pair.alias("g"), "fp", F.lit(0).alias("side")))
    out = None
    for part in found:
        made = part.repartition("g").sortWithinPartitions("g", "fp").mapInArrow(_compare, "u long, v long")
        out = made if out is None else out.unionByName(made)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: the smallest node reachable, for every node with a link; by alternating large and small stars."""
    edges = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = sign(edges)
    while True:  # each round brings every tree nearer to a star; nothing changes once all are
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch.keep(small)
        now = sign(new)
        scratch.drop(edges, large)
        edges = new
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, refine: int = REFINE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable, itself included) of every row of `docs`.

    Texts without words share fingerprint 0 and are linked like any other. Repeated rows stay, in one component. A null
    doc_id names no component but its row has one; component_id is null where all its rows' ids are. Other columns are
    ignored, an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, doc_id, text))
    first = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    star = components(links(first.select("fp"), scratch, bucket, refine), scratch)
    ends = star.select(F.col("node").alias("fp"), "root").unionByName(star.select(F.col("root").alias("fp"), "root").distinct())
    grouped = first.join(ends, "fp")
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    moved = scratch.keep(ends.join(least, "root").select("fp", "least"))
    named = scratch.keep(first.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with its own columns, one row of each component: one with the smallest id.

    Of rows repeated with that id one stays; of a component whose rows all lack an id one stays, too.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    marked = scratch.keep(near_duplicates(docs, doc_id, text))
    named = marked.where("doc_id = component_id").select("doc_id").distinct()
    # Rows without an id go by fingerprint: those of components without any id are the only ones that matter.
    nameless = scratch.keep(marked.where("component_id IS NULL").select("fp").distinct())
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    read = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    key = own[doc_id]
    kept = read.join(scratch.keep(named), F.col(key) == F.col("doc_id"), "left_semi").dropDuplicates([key])
    if not nameless.isEmpty():
        # The smallest text stands for each component; texts of equal fingerprints are in the same one.
        lost = read.where(F.col(key).isNull()).withColumn("_text", F.coalesce(own[text], F.lit("")))
        roots = _roots_without_id(lost, nameless, own, scratch)
        kept = kept.unionByName(roots.select(*own.values()))
    return kept.select(*(F.col(n).alias(c) for c, n in own.items()))


def _roots_without_id(lost: DataFrame, nameless: DataFrame, own: dict, scratch: Scratch) -> DataFrame:
    """One row of each component among rows that have no id, where the component has none."""
    star = components(links(nameless, scratch), scratch)
    root = nameless.join(star, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    best = F.min(F.struct("_text", *own.values())).alias("row")
    prints = fingerprints(lost.select("_text").distinct(), "_text", "_text").select(F.col("doc_id").alias("_text"), "fp")
    return lost.join(prints, "_text").join(root, "fp").groupBy("root").agg(best).select("row.*")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")

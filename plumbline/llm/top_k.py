"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into clusters around a few centres, and clusters into blocks of bounded size. In a block each
dimension has a list sorted by its value. The lists are read from both ends to a common depth, a row met in any list is
scored in full, and the value at the depth bounds what an unread row can still score: a query stops when that bound is
below its k-th score. Lists that are read to the middle have shown every row.

A query first meets one block of the cluster that suits it best. Its k-th score there goes with it: a cluster whose bound,
the centre's score and the query's norm times the cluster's radius, is below it is skipped with all its blocks, and in the
others the lists are read no further than it demands. Centres come from a bounded sample; they decide what is
skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, table

#: Rows of a block at most, and its components at most. A task holds one block of each kind.
QUERY_BLOCK, CANDIDATE_BLOCK, COMPONENTS = 1024, 16384, 1 << 20
#: Rows for each centre, centres at most, components of all centres at most, sample rows for each centre, and rounds of fitting.
PER_CENTRE, CENTRES, CENTRE_COMPONENTS, PER_FIT, FIT_ROUNDS = 2048, 512, 1 << 18, 16, 8
SCALE = 64
LONG = (-(2**63), 2**63 - 1)


def threshold_top_k(c: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int, first_depth: int = 32, known: np.ndarray | None = None) -> tuple[list[np.ndarray], int]:
    """For each row of `q` the positions in `c` of its k best rows, and how many scores were computed.

    `c` and `q` hold integers (as float64 where products stay exact, else as Python integers). Order: score, then the
    smaller id; rows with the query's own id are left out. known: scores of which k are known elsewhere, below which
    nothing need be found; NaN where none is.
    """
    n, d = c.shape
    best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    best_s: list[np.ndarray] = [np.zeros(0, c.dtype)] * len(q)
    if not n:
        return best, 0
    order = np.argsort(c, axis=0, kind="stable")
    lists = np.take_along_axis(c, order, axis=0)
    reach = np.full(n, n)  # the depth at which a row is first met
    place = np.arange(n)
    place = np.minimum(place, n - 1 - place)
    for j in range(d):
        reach[order[:, j]] = np.minimum(reach[order[:, j]], place)
    if not d:
        reach[:] = 0
    met = np.argsort(reach, kind="stable")
    up, down = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
    active, read, depth, scored = np.arange(len(q)), 0, min(first_depth, n), 0
    while len(active) and read < n:
        upto = int(np.searchsorted(reach[met], depth))
        new, read = met[read:upto], upto
        if len(new):
            s = q[active] @ c[new].T
            scored += s.size
            for row, i in zip(s, active, strict=True):
                own = ids[new] != qids[i]
                at, got = np.concatenate([best[i], new[own]]), np.concatenate([best_s[i], row[own]])
                if len(at) > k:
                    least = np.partition(got, len(got) - k)[len(got) - k]
                    top = np.flatnonzero(got >= least)
                    top = top[np.lexsort((ids[at[top]], -got[top]))[:k]]
                    at, got = at[top], got[top]
                best[i], best_s[i] = at, got
        if read < n:
            bound = up[active] @ lists[n - depth] + down[active] @ lists[depth - 1]
            kth = [best_s[i].min() if len(best[i]) == k else None for i in active]
            more = np.array([x is None or b >= x for x, b in zip(kth, bound, strict=True)], bool)
            if known is not None:
                more &= np.array([not b < x for x, b in zip(known[active], bound, strict=True)], bool)
            active = active[more]
        depth = min(n, depth * 4)
    return best, scored


def _matrix(a: pa.ChunkedArray, d: int) -> np.ndarray:
    """floor(SCALE * x) as float64; shorter vectors are filled up with zeros."""
    a = a.combine_chunks()
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0)
    lengths = np.asarray(a.value_lengths())
    out = np.zeros((len(a), d))
    out[np.arange(d)[None, :] < lengths[:, None]] = np.floor(np.asarray(a.flatten(), np.float64) * SCALE)
    return out


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """`n` centres of the rows of `x`, by Lloyd's rounds from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(FIT_ROUNDS):
        near = _nearest(x, c)[0]
        size = np.bincount(near, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return np.nan_to_num(c)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and its distance from it, rounded up; infinite where numbers are too large for it."""
    near, far = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            off = (c**2).sum(1) - 2 * (part @ c.T)
            near[at : at + 4096] = np.argmin(np.nan_to_num(off, nan=np.inf), axis=1)
            gap = np.sqrt(((part - c[near[at : at + 4096]]) ** 2).sum(1))
            far[at : at + 4096] = np.where(np.isfinite(gap), gap * (1 + 1e-9) + 1e-6, np.inf)
    return near, far


def _below(kth: pa.Array) -> np.ndarray:
    """Scores as doubles that are no larger; NaN for null and for what was cut to the range of a long."""
    at = kth.to_numpy(zero_copy_only=False).astype(float)
    return np.where(at > LONG[0], np.nextafter(at, -np.inf), np.nan)


_FOUND = "query_id long, vec_id long, score long, scored long"


def _meet(asked: DataFrame, rows: DataFrame, k: int, query_block: int) -> DataFrame:
    """What queries (vec_id, v, kth, block) find in their blocks of `rows` (vec_id, v, block): query_id, vec_id, score.

    Queries of a block are dealt into parts of bounded size, each of which meets a copy of the block; a block without
    queries goes nowhere. A row without a vec_id says in `scored` how many scores a part computed.
    """
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts"))
    q = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    c = rows.join(parts, "block").select("vec_id", "v", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = np.asarray(right["vec_id"], np.int64), np.asarray(left["vec_id"], np.int64)
        d = max([0, *(int(max(np.asarray(t["v"].combine_chunks().value_lengths()), default=0)) for t in (left, right) if t.num_rows)])
        cols = [np.zeros(0, np.int64)] * 3
        scored = 0
        if len(ids) and len(qids):
            m, w = _matrix(right["v"], d), _matrix(left["v"], d)
            if d * (np.abs(m).max(initial=0) + 1) * (np.abs(w).max(initial=0) + 1) >= 2**53:  # beyond exact doubles
                m, w = (np.array([[int(y) for y in r] for r in a], object).reshape(a.shape) for a in (m, w))
            known = _below(left["kth"].combine_chunks())
            found, scored = threshold_top_k(m, ids, w, qids, k, known=known)
            at = np.repeat(np.arange(len(qids)), [len(f) for f in found])
            pos = np.concatenate(found) if found else np.zeros(0, np.int64)
            score = np.array([min(LONG[1], max(LONG[0], int(s))) for s in (m[pos] * w[at]).sum(axis=1)], np.int64)
            fine = ~(score < known[at])
            cols = [qids[at][fine], ids[pos][fine], score[fine]]
        made = [pa.concat_arrays([pa.array(x, pa.int64()), pa.array([None], pa.int64())]) for x in cols]
        return pa.table([*made, pa.array([None] * len(cols[0]) + [scored], pa.int64())], names=["query_id", "vec_id", "score", "scored"])

    return q.groupBy("block", "part").cogroup(c.groupBy("block", "part")).applyInArrow(block, _FOUND)


def _fine(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v of the rows that take part."""
    x = F.col(embedding)
    fine = F.col(vec_id).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v"))


def found_scores(queries: DataFrame, candidates: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", per_centre: int = PER_CENTRE, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score: rows among which are the k best of each query; and rows without ids that hold `scored`."""
    spark = candidates.sparkSession
    scratch = Scratch(spark, "top_k")
    rows = _fine(candidates, vec_id, embedding)
    asked = scratch.keep(_fine(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v")))
    n, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], _FOUND)
    fit = max(1, COMPONENTS // max(1, d))
    rows_each, asked_each = min(candidate_block, fit), min(query_block, fit)
    n_centres = max(1, min(n // per_centre, CENTRES, CENTRE_COMPONENTS // max(1, d)))
    # PER_FIT rows for each centre at most, those of the smallest hashes; few enough for the driver.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PER_FIT * n_centres).select("v").toArrow()
    held = spark.sparkContext.broadcast(_centres(_matrix(sample["v"], d), n_centres))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, far = _nearest(_matrix(pa.chunked_array([b.column("v")]), d), held.value)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near, pa.int32()), pa.array(far)], ["vec_id", "v", "centre", "far"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = scratch.keep(rows.mapInArrow(place, f"vec_id long, v {kind}, centre int, far double").withColumn("row", F.monotonically_increasing_id()))
    # One row for each centre, of which there are CENTRES at most.
    sizes = {r.centre: (r.n, r.far) for r in placed.groupBy("centre").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    blocks = [-(-sizes.get(c, (0, 0))[0] // rows_each) for c in range(n_centres)]
    first = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    of = lambda values: F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), F.col("centre") + 1)
    # Blocks go by row, not by id, so that an id repeated without end still spreads.
    dealt = placed.select("vec_id", "v", (of(first[:-1]) + F.pmod(F.xxhash64("row"), of(blocks))).alias("block"))
    radius = np.array([sizes.get(c, (0, 0.0))[1] for c in range(n_centres)])
    there = np.array(blocks) > 0

    def bounds(v: pa.Array) -> np.ndarray:
        """The most that a query can score in each cluster; NaN is no bound."""
        w = _matrix(pa.chunked_array([v]), d)
        with np.errstate(over="ignore", invalid="ignore"):
            return w @ held.value.T + np.sqrt((w**2).sum(1))[:, None] * radius * (1 + 1e-9) + 1e-6

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _matrix(pa.chunked_array([b.column("v")]), d)
            with np.errstate(over="ignore", invalid="ignore"):
                best = np.argmax(np.where(there, np.nan_to_num(w @ held.value.T, nan=-np.inf), -np.inf), axis=1)
            best = np.where(there[best], best, int(np.argmax(there)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(best, pa.int32())], ["vec_id", "v", "centre"])

    start = asked.mapInArrow(begin, f"vec_id long, v {kind}, centre int")
    start = scratch.keep(start.select("vec_id", "v", (of(first[:-1]) + F.pmod(F.xxhash64("vec_id"), of(blocks))).alias("block")))
    early = scratch.keep(_meet(start.withColumn("kth", F.lit(None).cast("long")), dealt, k, asked_each))
    score = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = early.where("query_id IS NOT NULL").withColumn("rank", score).where(F.col("rank") == k)
    known = start.join(best.select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth")), "vec_id", "left")

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                kth = _below(s.column("kth"))
                open_ = ~(bounds(s.column("v")) < kth[:, None]) & there
                lists = [[x for c in np.flatnonzero(o).tolist() for x in range(first[c], first[c + 1]) if x != own] for o, own in zip(open_, s.column("block").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([s.column("vec_id"), s.column("v"), s.column("kth"), pa.array(lists, pa.list_(pa.int64()))], ["vec_id", "v", "kth", "blocks"])

    rest = known.select("vec_id", "v", "block", "kth").mapInArrow(go_on, f"vec_id long, v {kind}, kth long, blocks array<long>")
    late = _meet(rest.select("vec_id", "v", "kth", F.explode("blocks").alias("block")), dealt, k, asked_each)
    return early.unionByName(late)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", **how) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score.

    Components become floor(64 * x), x as double; the score is the integer inner product, held within the range of a
    long; ties go to the smaller vec_id; a row with the query's own id is no candidate. Rows whose id is null, or whose
    vector is null or holds null or non-finite components, take no part. An empty vector scores 0; of vectors of unequal
    length the common part counts. A query id that is repeated counts once, with its smallest vector; repeated candidate
    rows each take a rank. Other columns are ignored. Empty tables give an empty result.
    """
    found = found_scores(queries, candidates, k, vec_id, embedding, **how).where("query_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where("vec_id % 20 = 0"), rows)


SQL_OP10 = """
WITH f AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM f),
q AS (SELECT vec_id, list_transform(min(embedding), lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
      FROM f WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.c, c.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

import numpy as np

from pyspark.sql import functions as F

from plumbline.llm.top_k import found_scores, threshold_top_k, top_k


def brute(rows, k):
    nan = lambda v: v is None or any(x is None or not np.isfinite(x) for x in v)
    fine = [(i, [int(np.floor(float(np.float32(x)) * 64)) for x in v]) for i, v in rows if i is not None and not nan(v)]
    out = []
    for q, v in dict(reversed([r for r in fine if r[0] % 20 == 0])).items():
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in fine if i != q)
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(3)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).round(2).tolist()) for i in range(200)]
    rows += [(500 + i, [0.5] * 16) for i in range(60)]  # ties
    rows += [(700, None), (720, [None] + [1.0] * 15), (740, [float("nan")] * 16), (760, [float("inf")] * 16), (780, []), (800, [1.0, 2.0]), (None, [1.0] * 16), (820, [-1.0] * 16), (821, [3e4] * 16), (900, [1.0] * 16), (900, [1.0] * 16)]
    df = frame(spark, rows)
    assert sorted(map(tuple, top_k(df.where("vec_id % 20 = 0"), df, 20).collect())) == brute(rows, 20)


def test_few_candidates_and_none(spark):
    df = frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 0.0])])
    assert [tuple(r) for r in top_k(df.where("vec_id = 0"), df).collect()] == [(0, 1, 1, 4096)]
    assert top_k(df.limit(0), df).collect() == [] and top_k(df, df.limit(0)).collect() == []


def test_huge_values_stay_exact(spark):
    df = frame(spark, [(0, [2.0**40, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0 + 2**-6])])
    got = [tuple(r) for r in top_k(df.where("vec_id = 0"), df).collect()]
    assert got == [(0, 1, 2, 2**52 + 65 * 64), (0, 2, 1, 2**52 + 4096)]


def test_stops_before_it_has_read_all():
    rng = np.random.default_rng(0)
    c = np.floor(rng.normal(size=(20_000, 4)) * 5)
    c[:50] += 400
    q = np.full((3, 4), 8.0)
    best, scored = threshold_top_k(c, np.arange(20_000), q, np.array([-1, -2, -3]), 10)
    s = c @ q[0]
    want = np.lexsort((np.arange(20_000), -s))[:10]
    assert all(set(b) == set(want) for b in best) and scored < 0.2 * 3 * 20_000


def test_clusters_are_skipped(spark):
    """Exact with many small blocks, and in clustered rows only a part of all scores is computed."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24)) * 4
    rows = [(i, (centres[i * 7 % 20] + rng.normal(size=24) * 0.3).round(3).tolist()) for i in range(3000)]
    rows += [(4000, rows[0][1]), (4000, rows[1][1]), (4001, rows[0][1]), (4001, rows[0][1])]  # repeated ids, one of them asked for
    df = frame(spark, rows)
    how = {"per_centre": 100, "candidate_block": 64, "query_block": 16}
    asked = df.where("vec_id % 20 = 0")
    got = sorted(map(tuple, top_k(asked, df, 20, **how).collect()))
    assert [g for g in got if g[0] != 4000] == [b for b in brute(rows, 20) if b[0] != 4000]
    small = min((rows[0][1], rows[1][1]))
    assert [g for g in got if g[0] == 4000] == [b for b in brute([r for r in rows if r[0] != 4000] + [(4000, small)], 20) if b[0] == 4000]
    scored = found_scores(asked, df, 20, **how).agg(F.sum("scored")).first()[0]
    assert scored < 0.5 * len(rows) * asked.count()

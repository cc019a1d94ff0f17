import random
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm.mixing import flight, land, mixed, mixture
from tests.llm.helpers import docs, odd_rows, prose


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """By resharing what is above the bound, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        made = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if made[s] > most * sizes[s]]
        if not above:
            return fixed | made
        fixed |= {s: most * sizes[s] for s in above}


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(r[0], r[1], "odd") for r in odd_rows(rng)]
    for i in range(900):
        source = rng.choice(["a", "a", "a", "é", "b", None])
        rows.append((1000 + i, prose(rng, rng.choice([0, 1, 5, 40, 200])), source))
    return rows + [(5000, "same text again", "a")] * 60


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_targets_and_totals(spark, rows):
    got = mixture(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len((text or "").split())
    want = targets(size)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= max(8, 0.01 * want[s]) or s == "odd"
    times = [r.times for r in got if r.doc_id == 5000]
    f = want["a"] / size["a"]
    assert abs(sum(times) - f * 60) < 1


def test_reruns_agree_however_rows_are_dealt(spark, rows):
    one = sorted(map(repr, mixture(docs(spark, rows, 1), block=64, merge=2).collect()))
    two = sorted(map(repr, mixture(docs(spark, rows, 7), block=64, merge=2).collect()))
    assert one == two


def test_mixed_rows(spark, rows):
    d = docs(spark, rows)
    got = mixed(d)
    assert got.columns == d.columns
    want = defaultdict(int)
    for r in mixture(d).collect():
        want[r.doc_id, r.size] += r.times
    seen = defaultdict(int)
    for r in got.collect():
        seen[r.doc_id, len((r.text or "").split())] += 1
    assert dict(seen) == {k: v for k, v in want.items() if v}


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    for n, sizes in ((50, [3]), (200, [1, 2, 50, 700]), (7, [5, 9])):
        x = rng.choice(sizes, n).astype(float)
        pi = np.full(n, 0.37)
        out = flight(pi, x, rng.random)
        assert abs(out.sum() - pi.sum()) < 1e-6 and abs(out @ x - pi @ x) < 1e-5
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert set(land(out, rng.random)) <= {0.0, 1.0}


def test_inclusion_is_fair():
    x = np.array([1.0, 2, 3, 10, 20, 5, 7, 2])
    total = np.zeros(8)
    for seed in range(2000):
        draw = np.random.default_rng(seed).random
        total += land(flight(np.full(8, 0.3), x, draw), draw)
    assert np.abs(total / 2000 - 0.3).max() < 0.05


def test_edges(spark):
    assert mixture(docs(spark, [(1, "x")]).limit(0)).collect() == []
    got = mixture(docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixture(docs(spark, [(1, "x")]), share=(5, 2))

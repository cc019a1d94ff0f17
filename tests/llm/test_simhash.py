import random
import re

import numpy as np
import xxhash

from plumbline.llm.simhash import Scratch, bucket_links, components, links, near_duplicates, one_of_each
from tests.llm.helpers import docs, odd_rows, prose


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(s)) if s else 0


def reachable(fps, radius=3):
    """The smallest index reachable from each fingerprint."""
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    label = np.arange(len(a))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = odd_rows(rng)
    for k in range(25):
        base = prose(rng, 300)
        for j in range(4):
            w = base.split(" ")
            for _ in range(j):
                w[rng.randrange(len(w))] = "x"
            rows.append((100 + 4 * k + j, " ".join(w)))
    got = near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, text, *_ in rows:
        prints.setdefault(fingerprint(text), []).append(i)
    fps = list(prints)
    label = reachable(fps)
    least = {}
    for f, x in zip(fps, label, strict=True):
        for i in prints[f]:
            if i is not None:
                least[x] = min(least.get(x, i), i)
    want = sorted([(i, f, least.get(label[k])) for k, f in enumerate(fps) for i in prints[f]], key=repr)
    assert sorted([(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got], key=repr) == want
    assert len(set(label)) < len(fps)
    one = one_of_each(docs(spark, rows))
    assert one.columns == docs(spark, rows[:1]).columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(least.values()))


def test_buckets_dealt_again(spark):
    rng = np.random.default_rng(1)
    c = rng.integers(0, 2**63, 4, np.uint64)
    flips = sum((np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) * np.uint64(k % 2) for k in range(6))
    f = np.unique(np.concatenate([c[rng.integers(0, 4, 500)] ^ flips, rng.integers(0, 2**63, 60, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    label = reachable(f)
    want = {tuple(sorted(int(x) for x in f[label == k].view(np.int64))) for k in set(label)}
    for bucket, refine in ((1024, 3), (32, 1), (32, 0)):
        scratch = Scratch(spark, "t")
        root = {r.node: r.root for r in components(links(df, scratch, bucket, refine), scratch).collect()}
        groups = {}
        for x in f.view(np.int64):
            groups.setdefault(root.get(int(x), int(x)), []).append(int(x))
        assert {tuple(sorted(g)) for g in groups.values()} == want


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    for radius in (0, 1, 2, 3, 4, 6):
        f = np.sort(rng.integers(0, 2**10, 200, np.uint64) * np.uint64(0x0004001001))
        group = np.sort(rng.integers(0, 5, 200))
        u, v = bucket_links(group, f, radius=radius)
        for g in range(5):
            own = f[group == g]
            label = reachable(own, radius)
            assert all(own[label[list(own).index(a)]] <= a for a in own)
        assert (u >= v).all()


def test_nobody_has_an_id(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "quite another text that is here"), (None, "")]
    assert {r.text for r in one_of_each(docs(spark, rows)).collect()} == {r[1] for r in rows} and one_of_each(docs(spark, rows)).count() == 3


def test_empty(spark):
    d = docs(spark, [(1, "x")]).limit(0)
    assert near_duplicates(d).collect() == [] and one_of_each(d).collect() == []

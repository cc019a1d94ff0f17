import hashlib
import random
import re

import pytest

from plumbline.llm.decontaminate import contamination, decontaminate
from tests.llm.helpers import docs, odd_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for r in rows:
        w, hit, own = words(r[1]), set(), set()
        for win, ids in windows.items():
            n = len(win)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == win:
                    hit |= set(range(i, i + n))
                    own |= {str(x) for x in ids if x is not None}
        out.append((r[0], len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 12 + i)) for i in range(8)] + [(20, "short item here"), (21, ""), (22, None), (23, "..."), (None, prose(rng, 15)), (100, prose(rng, 10))]
    rows = odd_rows(rng)
    for k in range(30):
        text = prose(rng, rng.randint(0, 60))
        leak = items[k % len(items)][1]
        if k % 2 and leak:
            text += " ... " + leak.upper() + " !! " + prose(rng, 5)
        rows.append((100 + k, text))
    rows.append((300, f"{items[0][1]} {items[0][1]} {items[1][1]}"))
    return docs(spark, rows), spark.createDataFrame([*items, items[0]], "item_id long, text string"), rows, items


def test_against_brute_force(case):
    d, items, rows, raw = case
    want = brute(rows, raw)
    assert sorted(map(tuple, contamination(d, items).collect()), key=repr) == want
    assert sum(w[-1] for w in want) > 10


def test_beyond_the_broadcast_bound(case):
    d, items, rows, raw = case
    assert sorted(map(tuple, contamination(d, items, max_windows=0).collect()), key=repr) == brute(rows, raw)
    assert sorted(map(tuple, contamination(d, items, max_bytes=0).collect()), key=repr) == brute(rows, raw)
    with pytest.raises(ValueError):
        decontaminate(d, items, max_windows=0, join_beyond=False)


def test_modes(case):
    d, items, rows, _ = case
    left = decontaminate(d, items)
    assert left.columns == d.columns
    hit = {r.doc_id for r in contamination(d, items).collect() if r.contaminated}
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - hit
    cut = decontaminate(d, items, "spans")
    assert cut.columns == d.columns and cut.count() == len(rows)
    assert not any(r.contaminated and r.n_hit >= 10 for r in contamination(cut, items).collect())
    before = {r[0]: r[1] for r in rows}
    assert all(r.text == before[r.doc_id] for r in cut.collect() if r.doc_id is not None and r.doc_id not in hit)


def test_empty(spark, case):
    d, items, _, _ = case
    assert contamination(d.limit(0), items).collect() == []
    assert not any(r.contaminated for r in contamination(d, items.limit(0)).collect())
    assert decontaminate(d, items.limit(0)).count() == d.count()


def test_modes_beyond_the_broadcast_bound(case):
    d, items, _, _ = case
    for mode in ("documents", "spans"):
        within, beyond = decontaminate(d, items, mode), decontaminate(d, items, mode, max_windows=0)
        assert beyond.schema == within.schema
        assert sorted(map(tuple, beyond.collect()), key=repr) == sorted(map(tuple, within.collect()), key=repr)


def test_pipeline_stage_beyond_the_broadcast_bound(spark, case, tmp_path, monkeypatch):
    import corpus_pipeline
    from plumbline.llm.decontaminate import MAX_WINDOWS

    d, items, _, _ = case
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(decontaminate, "__defaults__", tuple(5 if x == MAX_WINDOWS else x for x in decontaminate.__defaults__))
    got = corpus_pipeline.drop_leaked(spark, d, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in contamination(d, items).where("NOT contaminated").collect()}


def test_memory_of_the_set_and_of_long_texts():
    import tracemalloc

    import pyarrow as pa

    from plumbline.llm.decontaminate import WindowSet
    from plumbline.llm.words import ALNUM, find_words
    import numpy as np

    n = 50_000
    t = pa.table({"size": pa.array([10] * n, pa.int32()), "hash": pa.array(np.random.default_rng(1).integers(0, 2**63, n)), "words": pa.array([b"some ten words of a window %d" % i for i in range(n)]), "item_id": [str(i // 40) for i in range(n)]})
    assert WindowSet(t).nbytes() < 10_000_000
    text = np.frombuffer(("word " * 2_000_000).encode(), np.uint8)
    tracemalloc.start()
    h = find_words(text, np.array([0, len(text)]), ALNUM).hashes()
    assert tracemalloc.get_traced_memory()[1] < 20 * len(text) and len(set(h[:9].tolist())) == 1
    tracemalloc.stop()

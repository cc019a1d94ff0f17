import random
import re
import zlib
from time import process_time

import numpy as np
import pytest

from plumbline.llm.toxicity import FEATURES, Lexicon, Trees, isotonic, masked_words, toxicity, without_toxic
from tests.llm.helpers import docs, odd_rows, prose

FOUL = [f"zork{x}" for x in "a b c d e f".split()]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(8)
    rows, labels = odd_rows(rng), []
    for i in range(600):
        w = prose(rng, rng.randint(20, 80)).split(" ")
        toxic = i % 6 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(FOUL))
        rows.append((100 + i, " ".join(w)))
        labels.append((100 + i, int(toxic)))
    extra = [(3, 0), (3, None), (None, 1), (99999, 1), (100, 1)]
    return docs(spark, rows), spark.createDataFrame([(a, 1, b) for a, b in labels + extra], "doc_id long, quality int, toxic int"), rows, dict(labels)


def test_held_out_rows(case):
    d, labels, rows, truth = case
    got = toxicity(d, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    left = without_toxic(d, labels)
    assert left.columns == d.columns and left.count() == sum(not r.predicted for r in got)


def test_held_out_labels_are_never_read(spark, case):
    d, labels, _, truth = case
    turned = spark.createDataFrame([(i, 0, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in truth.items()] + [(3, 0, 0), (100, 1, 1)], "doc_id long, quality int, toxic int")
    key = lambda df: sorted((r.doc_id or -1, r.score) for r in df.collect())
    assert key(toxicity(d, turned)) == key(toxicity(d, labels))


def test_without_labels(spark, case):
    d, labels, rows, _ = case
    assert {r.score for r in toxicity(d, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity(d, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity(d.limit(0), labels).collect() == []


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0)).astype(float)
    t = Trees().fit(x[:1500], y[:1500])
    assert ((t.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.97
    xs, ys = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.allclose(ys, [0, 0.5, 1])
    assert (np.diff(xs) > 0).all()


def test_masked_words():
    plain, rng = re.compile(r"[^\W\d_]+(?:[0-9@$!|*.+\-_]{1,3}[^\W\d_]+)+"), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("abé²ⅷ漢 1@$!|*.+-_\t(,") for _ in range(rng.randint(0, 30)))
        assert masked_words(text) == plain.findall(text)


def test_long_unbroken_texts():
    for bad in ("a" * 2_000_000, "a." * 1_000_000, "1" * 2_000_000, "a...." * 400_000, "idiot " * 300_000 + "you " * 10):
        began = process_time()
        Lexicon({"idiot": 4.0}, {"idio": 3.5}).features(bad, np.zeros(len(FEATURES)))
        assert process_time() - began < 10

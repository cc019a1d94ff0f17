import os
import random

import numpy as np
import pytest

from plumbline.llm.token_output import END, Encoder, PATTERN, feistel, read_slots, training_order, vocabulary, write_shards
from tests.llm.helpers import docs, odd_rows, prose


@pytest.fixture(scope="module")
def ranks():
    return vocabulary()


def whole(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_remembered_words_encode_alike(ranks):
    plain, own, rng = whole(ranks), Encoder(ranks), random.Random(1)
    parts = [" ", "  ", "\n", "a", "don't", "B1", "é", "...", " \t", "\n\n", "x y", "\xa0", "　", "漢字"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(own.encode(t), "<u2").tolist() == plain.encode_ordinary(t)


def test_feistel_permutes():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        assert sorted(feistel(np.arange(n), n)) == list(range(n))
    assert (feistel(np.arange(1000), 1000, 1) != feistel(np.arange(1000), 1000, 2)).any()


def test_round_trip(spark, ranks, tmp_path):
    rng = random.Random(4)
    rows = [r for r in odd_rows(rng) if r[0] != 5] + [(100 + i, prose(rng, rng.randint(0, 300))) for i in range(60)]
    ordered = training_order(docs(spark, rows), ranks, length=32, per_shard=64)
    got = ordered.collect()
    assert [r.slot for r in got] == list(range(len(got)))
    assert all(r.shard == r.slot // 64 and r.at == r.slot % 64 * 64 and len(r.ids) == 64 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.chunk, np.frombuffer(r.ids, "<u2")[: r.n_tokens].tolist()))
    enc = whole(ranks)
    for i, text in [(r[0], r[1]) for r in rows if r[0] is not None]:
        ids = [x for _, c in sorted(by[i]) for x in c]
        assert ids[-1] == END and enc.decode(ids[:-1]) == (text or "")
    assert len(by) == len({r[0] for r in rows})
    shards = write_shards(ordered, f"file://{tmp_path}/out", 32).collect()
    assert sum(s.n for s in shards) == len(got) and len(shards) == -(-len(got) // 64)
    for slot in (0, 63, 64, 100):
        read = list(read_slots(f"{tmp_path}/out", slot, 32, 64))
        assert len(read) == len(got) - slot and all((a == np.frombuffer(r.ids, "<u2")).all() for a, r in zip(read, got[slot:], strict=True))
    assert [r.slot for r in training_order(docs(spark, rows), ranks, length=32, per_shard=64).collect()] == [r.slot for r in got]
    with pytest.raises(ValueError):
        write_shards(ordered, "hdfs://x/y")


def test_empty(spark, ranks):
    assert training_order(docs(spark, [(1, "x")]).limit(0), ranks).collect() == []


def test_long_white_space(ranks):
    plain, own, rng = whole(ranks), Encoder(ranks), random.Random(2)
    blanks = [" ", "\n", "\t", "\u2003", "\xa0"]
    for _ in range(60):  # short enough for the whole pattern
        t = "".join(rng.choice(["word", "x1", "", "don't "]) + rng.choice(blanks) * rng.choice([1, 2, 999, 1000, 1500]) for _ in range(4)) + rng.choice(["", "end"])
        assert np.frombuffer(own.encode(t), "<u2").tolist() == plain.encode_ordinary(t)
    for bad in ("\n" * 1_000_000, " " * 2_000_000 + "x", "a" + " \n" * 500_000 + "b"):
        ids = np.frombuffer(own.encode(bad), "<u2").tolist()
        assert plain.decode(ids) == bad


def test_slots_don_t_depend_on_partitions(spark, ranks):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(0, 200))) for i in range(50)] + [(7, prose(rng, 30)), (8, "same"), (8, "same"), (None, "lost"), (None, "lost too"), (None, None)]
    seen = []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = training_order(docs(spark, rows, parts), ranks, length=16, per_shard=32).collect()
        seen.append([(r.slot, r.shard, r.at, r.doc_id, r.chunk, r.n_tokens, bytes(r.ids)) for r in got])
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 300


def test_texts_moved_for_the_order_leave_no_files(spark, ranks):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f: os.path.getsize(f) for f in files.split("\n") if "shuffle_" in f and f.endswith(".data") and os.path.exists(f)}

    rng = random.Random(3)
    rows = [(i, prose(rng, 500)) for i in range(200)]
    before, key = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    ordered = training_order(docs(spark, rows), ranks, length=16)
    assert sum(n for f, n in held().items() if f not in before) < sum(len(t) for _, t in rows) / 20  # the counts of its tasks
    assert spark.conf.get(key, None) == was and ordered.count() > 200

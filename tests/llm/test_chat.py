import os
import random

import duckdb
import pytest

from plumbline.llm.chat import SQL_OP2, op2_chat_perspectives, perspectives
from tests.llm.helpers import prose

SCHEMA = "conv_id long, turn long, role string, text string, chunk int, spans string, said string, i long, part int, speaker string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, "z") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    """Whole perspectives: conv_id, speaker, text, spans."""
    dialogues = {}
    for c, t, role, text in set(rows):
        dialogues.setdefault(c, set()).add((t, role if role is not None else "unknown", text or ""))
    out = []
    for c, turns in dialogues.items():
        turns = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        for who in {r for _, r, _ in turns} - {"system"}:
            text, spans = "", []
            for _, role, said in turns:
                text += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user {role}|>\n"
                body = said + "<|end|>\n"
                if role == who:
                    spans.append((len(text), len(body)))
                text += body
            out.append((c, who, text, tuple(spans)))
    return sorted(out, key=repr)


def whole(df):
    """Chunks put together, each in its place."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.chunk):
        text, spans, n = out.get((r.conv_id, r.speaker), ("", (), 0))
        assert r.chunk == n and r.offset == len(text) and r.n_trained == sum(s.length for s in r.spans)
        out[r.conv_id, r.speaker] = text + r.text, spans + tuple((r.offset + s.start, s.length) for s in r.spans), n + 1
    return sorted(((c, who, text, spans) for (c, who), (text, spans, _) in out.items()), key=repr)


def mixed_rows():
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["ann", "bob", "eve", "system"]), prose(rng, 5)) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "zoe" if t == 3 else "ann" if t % 2 else "bob", f"turn {t}") for t in range(5000)]  # a long dialogue, one speaker silent but for a turn
    rows += [(60, 0, None, "who"), (60, 1, "ann", None), (60, None, "bob", ""), (None, 0, "ann", "lost"), (None, 1, "bob", "too"), (70, 0, "system", "alone"), (80, 1, "ann", "b"), (80, 1, "ann", "a"), (80, 1, "ann", "a")]
    return [*rows, (90, 0, "ann", prose(rng, 20_000)), (91, 0, "ann", "ünï漢")]


def test_against_brute_force(spark):
    rows = mixed_rows()
    got = perspectives(frame(spark, rows)).cache()
    assert whole(got) == brute(rows)
    assert all(r.text[s.start : s.start + s.length].endswith("<|end|>\n") for r in got.collect() for s in r.spans)
    sizes = [r.n_turns for r in got.where("conv_id = 50 AND speaker = 'zoe'").orderBy("chunk").collect()]
    assert sizes == [512] * 9 + [392]


def test_small_chunks_give_the_same(spark):
    rows = [r for r in mixed_rows() if r[0] != 50]
    assert whole(perspectives(frame(spark, rows), most=2)) == brute(rows)


def test_one_number_for_all_turns(spark):
    rows = [(1, 0, "ann" if i % 2 else "bob", f"text {i}") for i in range(5000)]
    assert whole(perspectives(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    assert perspectives(frame(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []


def test_repeated_rows_cut_nothing(spark):
    rows = [(1, t, "ann" if t % 2 else "bob", f"turn {t}") for t in range(10)]
    got = perspectives(frame(spark, rows * 200))
    assert whole(got) == brute(rows) and got.count() == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_query_against_sql(spark, tmp_path, parts):
    """The rows of odd dialogues and of one of 5,000 turns, repeated, are those of the SQL."""
    rows = mixed_rows()
    frame(spark, rows + rows[::3]).repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(SQL_OP2)
    cols = [c[0] for c in cur.description]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = op2_chat_perspectives(spark, str(tmp_path))
        assert sorted(df.columns) == sorted(cols)
        assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert os.path.isdir(tmp_path)

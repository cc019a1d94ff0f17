import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, delete
from plumbline.llm.token_counts import SQL_OP4, TokenLedger, changes, counted, op4_token_counts, token_counts_by_vocabulary
from tests.llm.helpers import docs, odd_rows, prose


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(*r, None) for r in odd_rows(rng)] + [(100 + i, prose(rng, i), rng.choice(["a", "b"]), rng.choice(["en", None])) for i in range(40)]


def sums(df):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in df.collect()}


def brute(rows):
    out = defaultdict(lambda: [0, 0])
    for r in rows:
        key = (r[2], r[3] if len(r) > 3 else "en", "space-1")
        out[key][0] += 1
        out[key][1] += len((r[1] or "").split())
    return {k: tuple(v) for k, v in out.items()}


def test_batches(spark, rows):
    ledger = TokenLedger(spark, Scratch(spark, "t").path())
    assert ledger.totals().collect() == []
    all_ = counted(docs(spark, rows))
    assert ledger.commit("load", changes(all_, 1, "space-1")) and not ledger.commit("load", changes(all_, 1, "space-1"))
    assert sums(ledger.totals()) == brute(rows)
    gone = all_.where("doc_id % 2 = 0")
    assert ledger.commit("delete", changes(gone, -1, "space-1"))
    left = [r for r in rows if r[0] is None or r[0] % 2]
    assert sums(ledger.totals()) == brute(left)
    ledger.compact()
    assert sums(ledger.totals()) == brute(left) and not ledger.commit("delete", changes(gone, -1, "space-1"))
    ledger.compact()
    # A batch that broke off has no mark of success: it doesn't count and can be committed.
    assert ledger.commit("again", changes(gone, 1, "space-1"))
    delete(spark, f"{ledger.path}/batches/again/_SUCCESS")
    assert sums(ledger.totals()) == brute(left)
    assert ledger.commit("again", changes(gone, 1, "space-1")) and sums(ledger.totals()) == brute(rows)
    ledger.commit("all", changes(all_, -1, "space-1"))
    assert ledger.totals().collect() == []
    with pytest.raises(ValueError):
        ledger.commit("../x", changes(gone, 1, "space-1"))


def test_real_tokenizer(spark, rows):
    def maker():
        import public_tokenizers as p
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)

    count = maker()
    got = counted(docs(spark, [r for r in rows if r[0] != 4]), {"bpe-1": maker})
    assert sorted(r["bpe-1"] for r in got.collect()) == sorted(count(r[1] or "") for r in rows if r[0] != 4)


def test_stream(spark, rows, tmp_path):
    src, ledger = f"file://{tmp_path}/in", TokenLedger(spark, f"file://{tmp_path}/ledger")
    changes(counted(docs(spark, rows)), 1, "space-1").withColumn("x", F.lit(1)).drop("x").write.parquet(src)
    schema = "source string, lang string, tokenizer string, docs long, tokens long"
    for _ in range(2):  # started again, it commits nothing twice
        q = ledger.follow(spark.readStream.schema(schema).parquet(src), "s", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sums(ledger.totals()) == brute(rows)


def test_query_against_sql_with_odd_rows(spark, rows, tmp_path):
    """Texts whose rows all lack an id, and ties, are counted by the same rule."""
    odd = [*rows, (None, "only lost words", "a", "en"), (None, "only lost words", "b", None), (None, "lost and found", "b", "en"), (9, "lost and found", "a", None), (9, "lost and found", None, "en")]
    docs(spark, odd).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(SQL_OP4)
    cols = [c[0] for c in cur.description]
    got = op4_token_counts(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got))) == sorted(map(repr, cur.fetchall()))


def test_vocabulary_counts(spark, rows, tmp_path):
    import tiktoken

    from plumbline.llm.token_output import PATTERN, vocabulary

    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary(), special_tokens={}).encode_ordinary
    want = defaultdict(lambda: [0, 0])
    for r in rows:
        key = (r[2], r[3] if len(r) > 3 else "en", "byte_bpe_50k-1")
        want[key][0] += 1
        want[key][1] += len(encode(r[1] or ""))
    assert sums(token_counts_by_vocabulary(spark, str(tmp_path))) == {k: tuple(v) for k, v in want.items()}


def test_compaction_keeps_a_number_for_a_stream(spark, rows):
    ledger = TokenLedger(spark, Scratch(spark, "t").path())
    change = changes(counted(docs(spark, rows[-3:])), 1, "space-1")
    for batch in ("s-0", "s-1", "other", "s-3"):
        assert ledger.commit(batch, change)
    before = sums(ledger.totals())
    ledger.compact()
    assert ledger._snapshot()[1] == {"s": 1, "other": None, "s-3": None} and ledger._whole("batches") == []
    assert sums(ledger.totals()) == before and not any(ledger.commit(b, change) for b in ("s-0", "s-1", "other", "s-3"))
    assert ledger.commit("s-2", change)
    ledger.compact()
    assert ledger._snapshot()[1] == {"s": 3, "other": None} and not ledger.commit("s-2", change) and ledger.commit("s-4", change)
    for _ in range(3):
        ledger.compact()
    assert len(ledger._whole("folded")) == 2 and {k: (a * 6 // 4, b * 6 // 4) for k, (a, b) in before.items()} == sums(ledger.totals())

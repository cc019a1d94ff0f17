"""Delta-maintained token counts.

A ledger in a folder holds one table of signed sums for each committed batch: inserted documents add, deleted ones
subtract, a revised count subtracts the old and adds the new. Totals by source, language and tokenizer version are the
sums of all batches, so no document is counted again. A batch that is there is there whole (Spark's _SUCCESS mark) and
committing its id again changes nothing; one that broke off is written anew. Compaction folds batches into a snapshot
that says which they are, and removes them: of a stream's numbered batches it keeps the last number alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, delete, table, text_bytes, text_chunks
from plumbline.llm.token_output import Encoder, vocabulary
from plumbline.llm.words import ALNUM, INK

KEY = ("source", "lang", "tokenizer")
_LETTERS = ALNUM & ~np.array([48 <= b <= 57 for b in range(256)])
#: Tokenizers of bytes: runs of anything but white space; of letters and digits; of letters. Beyond ASCII all are letters.
RUNS = {"space-1": INK, "alnum-1": ALNUM, "alpha-1": _LETTERS}


def run_counts(data: np.ndarray, offsets: np.ndarray, ink: np.ndarray) -> np.ndarray:
    """How many runs of `ink` bytes each text has."""
    inside = ink[data]
    blank = np.ones(len(data), bool)
    blank[1:] = ~inside[:-1]
    blank[offsets[offsets < len(data)]] = True
    total = np.concatenate([[0], np.cumsum(inside & blank)])
    return total[offsets[1:]] - total[offsets[:-1]]


def counted(docs: DataFrame, tokenizers: dict[str, np.ndarray | Callable[[], Callable[[str], int]]] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, source, lang, digest (of the text, null for a null one) and a count for each tokenizer, by its name.

    A tokenizer is a table of bytes whose runs are tokens, or a maker of a function that counts a text's tokens; the
    maker is called once in each task. A null or empty text has none. Rows are counted each for itself, repeated ones
    and those without an id too; other columns are ignored; an empty table gives an empty result.
    """
    own = RUNS if tokenizers is None else tokenizers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {k: v if isinstance(v, np.ndarray) else v() for k, v in own.items()}
        for b in text_chunks(batches):
            data, offsets = text_bytes(b.column("text"))
            texts = b.column("text").to_pylist()
            digests = pa.array([None if t is None else hashlib.md5(t.encode()).digest() for t in texts], pa.binary())
            counts = [pa.array(run_counts(data, offsets, v) if isinstance(v, np.ndarray) else [v(t or "") for t in texts], pa.int64()) for v in ready.values()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), digests, *counts], ["doc_id", "source", "lang", "digest", *ready])

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    names = ", ".join(f"`{k}` long" for k in own)
    return read.mapInArrow(count, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, source string, lang string, digest binary, {names}")


def changes(rows: DataFrame, sign: int, *tokenizers: str) -> DataFrame:
    """Signed changes for documents that come (sign 1) or go (-1): source, lang, tokenizer, docs, tokens."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tokenizer"), F.col(f"`{t}`").alias("tokens")) for t in tokenizers)))
    return rows.select("source", "lang", each.alias("c")).select("source", "lang", "c.tokenizer", F.lit(sign).cast("long").alias("docs"), (sign * F.col("c.tokens")).alias("tokens"))


class TokenLedger:
    """Totals kept by batches in `path`, a folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _whole(self, kind: str) -> list[str]:
        fs, p = self._files(f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        return [n for n in names if self._is_whole(f"{self.path}/{kind}/{n}")]

    def _is_whole(self, path: str) -> bool:
        fs, p = self._files(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _snapshot(self) -> tuple[str | None, dict[str, int | None]]:
        """The last snapshot; for a stream that is in it the last number up to which it is, for other batches None."""
        last = max(self._whole("folded"), default=None)
        return last, {r.name: r.upto for r in self.spark.read.parquet(f"{self.path}/folded/{last}").collect()} if last else {}

    def _folded(self, batch: str, folded: dict[str, int | None]) -> bool:
        stream, _, number = batch.rpartition("-")
        upto = folded.get(stream)
        return batch in folded or upto is not None and number.isdecimal() and int(number) <= upto

    def has(self, batch: str) -> bool:
        """Whether a batch was committed."""
        return self._folded(batch, self._snapshot()[1]) or self._is_whole(f"{self.path}/batches/{batch}")

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of signed changes; False, and no change, if it was committed before.

        A batch named "stream-n", n counting from 0, is one of a stream's.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch id: {batch!r}")
        if self.has(batch):
            return False
        signed.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; keys of which nothing is left are left out."""
        last, folded = self._snapshot()
        paths = [f"{self.path}/batches/{b}" for b in self._whole("batches") if not self._folded(b, folded)] + ([f"{self.path}/totals/{last}"] if last else [])
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        summed = rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all batches into a snapshot. It counts once its list of batches is whole, which is written last.

        Then what it replaces is removed: the batches, and all snapshots but the one before, which a reader may be at.
        A compaction that broke off is finished by the next.
        """
        last, folded = self._snapshot()
        fresh = [b for b in self._whole("batches") if not self._folded(b, folded)]
        if fresh:
            now = dict(folded)
            for b in fresh:
                stream, _, number = b.rpartition("-")
                if stream and number.isdecimal() and number == str(int(number)):
                    now[b] = None
                    while f"{stream}-{(upto := now.get(stream, -1) if now.get(stream, -1) is not None else -1) + 1}" in now:
                        del now[f"{stream}-{upto + 1}"]
                        now[stream] = upto + 1
                else:
                    now[b] = None
            name = f"{int(last or 0) + 1:08d}"
            self.totals().write.mode("overwrite").parquet(f"{self.path}/totals/{name}")
            self.spark.createDataFrame(sorted(now.items()), "name string, upto long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folded/{name}")
            last, folded = name, now
        for b in self._whole("batches"):
            if self._folded(b, folded):
                delete(self.spark, f"{self.path}/batches/{b}")
        for kind in ("folded", "totals"):
            for name in self._whole(kind):
                if last and int(name) < int(last) - 1:
                    delete(self.spark, f"{self.path}/{kind}/{name}")

    def follow(self, stream: DataFrame, name: str, checkpoint: str):
        """A streaming query that commits each micro-batch of signed changes once, by its id."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.commit(f"{name}-{n}", df) and None)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load of all documents, the removal of exact copies, and a change of one tokenizer's version.

    Of documents of one text the one with the smallest id stays, one without an id only if none has one; where ids are
    equal too, the smallest source, then language, nulls first. A null source, language or text is one like any other; an
    empty table has no totals. Then "alnum-1" counts are revised to "alpha-1". The first
    two batches are committed twice, as after a lost answer.
    """
    scratch = Scratch(spark, "counts")
    ledger = TokenLedger(spark, scratch.path())
    all_ = scratch.keep(counted(table(spark, sf_dir, "documents")))
    order = F.struct(F.col("doc_id").isNull().alias("_lost"), "doc_id", "source", "lang", *(f"`{t}`" for t in RUNS))
    firsts = all_.groupBy("digest").agg(F.min(order).alias("f")).select("f.*")
    kept = scratch.keep(firsts)
    load = lambda: changes(all_, 1, "space-1", "alnum-1")
    copies = lambda: changes(all_, -1, "space-1", "alnum-1").unionByName(changes(kept, 1, "space-1", "alnum-1"))
    for batch, made in (("load", load), ("copies", copies), ("load", load), ("copies", copies)):
        ledger.commit(batch, made())
    ledger.compact()
    ledger.commit("revise", changes(kept, -1, "alnum-1").unionByName(changes(kept, 1, "alpha-1")))
    return ledger.totals()


def token_counts_by_vocabulary(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Totals of all documents in tokens of a public vocabulary. No SQL: tested against the tokenizer itself."""
    ranks = vocabulary(path) if path else vocabulary()
    held = spark.sparkContext.broadcast(ranks)

    def maker() -> Callable[[str], int]:
        encode = Encoder(held.value).encode
        return lambda text: len(encode(text)) // 2

    name = "byte_bpe_50k-1"
    ledger = TokenLedger(spark, Scratch(spark, "counts").path())
    ledger.commit("load", changes(counted(table(spark, sf_dir, "documents"), {name: maker}), 1, name))
    return ledger.totals()


SQL_OP4 = r"""
WITH d AS (
  SELECT source, lang, text FROM documents
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, source NULLS FIRST, lang NULLS FIRST) = 1),
n AS (
  SELECT source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS a,
         len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS b FROM d)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(t) AS BIGINT) AS tokens
FROM (SELECT source, lang, 'space-1' AS tokenizer, a AS t FROM n UNION ALL SELECT source, lang, 'alpha-1', b FROM n)
GROUP BY source, lang, tokenizer
"""

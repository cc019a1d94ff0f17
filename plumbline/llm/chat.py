"""Multi-party chat formatting by perspective rotation.

For every participant of a dialogue the whole dialogue is rendered once, with that speaker as the assistant and the others
as named users; the spans to be trained on are the assistant's own words. Only DataFrame functions are used.

A perspective comes in chunks of CHUNK turns, in order: one after the other they are the perspective, and a chunk's offset
says how many characters are before it. Turns get their places by a sort in ranges, so no task has to hold a dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, table

#: Turns of a chunk; the last of a dialogue has fewer.
CHUNK = 512
#: Roles that speak to all and are nobody's perspective.
BACKGROUND = ("system",)
UNKNOWN = "unknown"
ASSISTANT, END = "<|assistant|>\n", "<|end|>\n"


def _plain(role: Column) -> Column:
    """What stands before a turn of `role` where somebody else is the assistant."""
    return F.when(role.isin(*BACKGROUND), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user "), role, F.lit("|>\n")))


def _same(a: str, b: str, *more: str) -> Column:
    """Equal dialogues, null among them, of the frames `a` and `b`, and equal `more`."""
    on = F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    for c in more:
        on = on & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return on


def _placed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """`turns` with i, a turn's place in its dialogue.

    Sorted in ranges, a dialogue lies in one partition or in some that follow each other; within one its turns are
    numbered there. A partition's first dialogue alone can have begun in an earlier one, so there are no more starts to
    carry over than partitions.
    """
    order = ["conv_id", "turn", "role", "text"]
    n = min(4096, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = scratch.keep(turns.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.withColumn("before", before).where("before IS NOT NULL").select("conv_id", "part", "before")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")) - 1
    own = dealt.withColumn("place", place)
    joined = own.alias("a").join(F.broadcast(carried).alias("b"), _same("a", "b", "part"), "left")
    return joined.select("a.*", (F.col("place") + F.coalesce("before", F.lit(0))).alias("i")).drop("part", "place")


def perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = CHUNK) -> DataFrame:
    """conv_id, speaker, chunk, offset, n_turns, text, spans (start and length in the chunk's characters), n_trained.

    chunk counts from 0, `most` turns each; offset is the number of the perspective's characters before it; n_turns and
    n_trained (characters of the spans) are the chunk's. Every participant has every chunk, those without a word of
    theirs too. Turns go by number, then role, then text, nulls first. Rows that repeat a turn in all of these count
    once. A null role is a participant named "unknown", a null text is empty and its span holds the end mark alone; null
    conv_ids are one dialogue. A dialogue in which only background roles speak has no perspective and so no row. Other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    read = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = _placed(read.distinct(), scratch)
    by_chunk = placed.groupBy("conv_id", F.floor(F.col("i") / most).alias("chunk"))
    dialogue = scratch.keep(by_chunk.agg(F.array_sort(F.collect_list(F.struct("i", "role", "text"))).alias("turns")))
    # Offsets from what each role adds to each chunk: the assistant's turns differ from a user's by their heads alone.
    said = dialogue.select("conv_id", "chunk", F.explode(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.length(t["text"]).alias("n")))).alias("t")).select("conv_id", "chunk", "t.*")
    adds = F.sum(F.col("n") + F.length(_plain(F.col("role"))) + len(END))
    roles = scratch.keep(said.groupBy("conv_id", "chunk", "role").agg(F.count("*").alias("own"), adds.alias("length")))
    earlier = lambda *key: Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = roles.groupBy("conv_id", "chunk").agg(F.sum("length").alias("length")).withColumn("before", F.coalesce(F.sum("length").over(earlier("conv_id")), F.lit(0)))
    speakers = roles.where(~F.col("role").isin(*BACKGROUND)).select("conv_id", F.col("role").alias("speaker")).distinct()
    grid = chunks.alias("a").join(speakers.alias("b"), _same("a", "b")).select("a.conv_id", "chunk", "before", "speaker")
    spoken = roles.select("conv_id", "chunk", F.col("role").alias("speaker"), "own")
    grid = grid.alias("a").join(spoken.alias("b"), _same("a", "b", "chunk", "speaker"), "left").select("a.*", F.coalesce("own", F.lit(0)).alias("own"))
    own_before = F.coalesce(F.sum("own").over(earlier("conv_id", "speaker")), F.lit(0))
    grid = grid.withColumn("offset", F.col("before") + own_before * (len(ASSISTANT) - F.length(_plain(F.col("speaker")))))
    each = dialogue.alias("a").join(grid.alias("b"), _same("a", "b", "chunk")).select("a.*", "speaker", "offset")
    speaker = F.col("speaker")
    head = lambda r: F.when(r == speaker, F.lit(ASSISTANT)).otherwise(_plain(r))
    each = each.withColumn("said", F.transform("turns", lambda t: F.struct(head(t["role"]).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == speaker).alias("own"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        body = acc["at"] + F.length(m["head"])
        span = F.struct(body.alias("start"), F.length(m["body"]).alias("length"))
        return F.struct((body + F.length(m["body"])).alias("at"), F.when(m["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("said", start, step)["spans"]
    whole = F.array_join(F.transform("said", lambda m: F.concat(m["head"], m["body"])), "")
    out = each.select("conv_id", "speaker", "chunk", "offset", F.size("turns").alias("n_turns"), whole.alias("text"), spans.alias("spans"))
    return out.withColumn("n_trained", F.aggregate("spans", F.lit(0), lambda n, s: n + s["length"]))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), " ")
    return made.select("conv_id", "speaker", "chunk", "offset", F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("spans"), F.col("n_trained").cast("long").alias("n_trained"))


SQL_OP2 = """
WITH m AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM m),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
r AS (
  SELECT p.conv_id, speaker, i, i // 512 AS chunk, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user ' || role || '|>' END || chr(10) AS head,
         text || '<|end|>' || chr(10) AS body
  FROM p JOIN o ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY i) AS upto FROM r),
c AS (SELECT *, min(upto - length(head) - length(body)) OVER (PARTITION BY conv_id, speaker, chunk) AS begins FROM s)
SELECT conv_id, speaker, CAST(chunk AS BIGINT) AS chunk, CAST(begins AS BIGINT) AS "offset", count(*) AS n_turns, string_agg(head || body, '' ORDER BY i) AS text,
       coalesce(string_agg(CAST(upto - length(body) - begins AS VARCHAR) || '+' || CAST(length(body) AS VARCHAR), ' ' ORDER BY i) FILTER (WHERE own), '') AS spans,
       CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_trained
FROM c GROUP BY conv_id, speaker, chunk, begins
"""

import datetime as dt

from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.streaming import observations as obs

T0 = dt.datetime(2024, 1, 1)
EVENTS = [
    ("1", 0, "enter", None), ("1", 1, "hit", "a"), ("1", 2, "hit", "b"), ("1", 3, "exit", None),
    ("2", 0, "enter", None), ("2", 1, "exit", None), ("2", 2, "hit", "late"),
    ("3", 0, "enter", None), ("3", 9, "hit", "slow"),
    ("4", 0, "hit", "before"), ("4", 1, "enter", None), ("4", 2, "enter", None), ("4", 3, "hit", "c"),
]
WANT = {("1", 0, "a"), ("2", 0, None), ("3", 0, None), ("4", 1, None), ("4", 2, "c")}


def rows(spark, extra=()):
    made = [(t, T0 + dt.timedelta(seconds=s), e, f, i) for i, (t, s, e, f) in enumerate([*EVENTS, *extra])]
    return spark.createDataFrame(made, "tid string, ts timestamp, event string, fn string, ord long")


def found(df):
    return {(r.tid, int((r.entered - T0).total_seconds()), r.hit_fn) for r in df.collect() if r.tid != "z"}


def test_batch(spark):
    assert found(obs.first_hits(rows(spark))) == WANT


def test_stream(spark, tmp_path):
    # A last event far ahead moves the watermark, so that open calls end.
    rows(spark).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    for i, s in enumerate((100, 200)):
        rows(spark, [("z", s, "other", None)]).where("tid = 'z'").write.parquet(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(rows(spark).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = obs.stream_first_hits(stream).writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    assert found(spark.table("hits")) == WANT


def test_states(spark):
    edge = lambda *r: (*r, None)
    edges = spark.createDataFrame([edge("f", "x", "a", "dynamic", None, "verified"), edge("f", "y", "b", "dynamic", None, "verified"), edge("f", "z", "c", "dynamic", None, None), edge("g", "x", "d", "static", None, "verified")], schemas.RESOLVES_TO)
    old = obs.mark_stale(edges)
    assert sorted((r.callExpression, r.target, r.state) for r in old.collect()) == [("x", "a", "stale"), ("x", "d", "verified"), ("y", "b", "stale"), ("z", "c", None)]
    seen = spark.createDataFrame([("f", "x", "a", 1), ("f", "x", "new", 2), ("f", "x", None, 3), ("h", "q", "w", 1)], "caller_fn string, call_site string, hit_fn string, ts int")
    now = F.lit(1000).cast("long")
    new = obs.checkup(old, seen, now)
    assert sorted((r.callExpression, r.target, r.state, r.validUntil) for r in new.where("resolvedBy = 'dynamic' AND state IS NOT NULL").collect()) == [("x", "new", "verified", 1000 + 604800), ("y", "b", "stale", None)]
    assert tuple(obs.checkup_counts(old, new).first()) == (1, 1)
    assert obs.stale(new).count() == 1 and obs.stale(old, 1).count() == 1
    more = obs.record_observations(new, seen, now)
    assert more.count() == 5 and more.where("callerFunction = 'h'").first().target == "w"
    late = obs.expire(more, F.lit(10**9).cast("long"))
    assert late.where("state = 'verified' AND resolvedBy = 'dynamic'").count() == 0

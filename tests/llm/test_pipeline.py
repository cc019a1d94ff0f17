"""The pipeline's stages, each on its own input, and the registration of its query."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from plumbline.llm.decontaminate import contamination
from plumbline.llm.mixing import mixture
from plumbline.llm.simhash import near_duplicates
from plumbline.llm.toxicity import toxicity
from tests.llm.helpers import prose

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    to = f"file://{tmp_path_factory.mktemp('tables')}"
    items = [(i, prose(rng, 15)) for i in range(4)]
    rows, labels = [], []
    for i in range(240):
        text = prose(rng, rng.randint(30, 90))
        toxic = i % 8 == 0
        if toxic:
            text = f"zorka {text} zorkb"
        if i % 10 == 3:
            text += " " + items[i % 4][1]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s1", 5) for i in range(0, 60)] + [(2000, None, "en", None, 0), (2001, "", None, "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return to


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "token_output"]
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        made = spark.read.parquet(path)
        if name == "toxicity":
            want = sorted(r.doc_id for r in toxicity(docs, labels).collect() if not r.predicted)
        elif name == "near_copies":
            want = sorted({r.component_id for r in near_duplicates(docs).collect()})
        elif name == "decontamination":
            want = sorted(r.doc_id for r in contamination(docs, items).collect() if not r.contaminated)
        elif name == "mixing":
            want = sorted(r.doc_id for r in mixture(docs).collect() for _ in range(r.times))
        else:
            assert set(ids(made)) == set(ids(docs)) and sorted(r.slot for r in made.collect()) == list(range(made.count()))
            break
        assert made.columns == NAMES and ids(made) == want, name
        assert len(want) != docs.count(), name
        docs = made


def test_run_and_registration(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert q["pipeline"] is corpus_pipeline.run and "pipeline" not in sql
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert set(sql) <= set(q)


def test_shards_are_read_from_the_middle(spark, folder, tmp_path):
    from plumbline.llm.token_output import read_slots, write_shards

    out = corpus_pipeline.run(spark, folder)
    want = [bytes(r.ids) for r in out.orderBy("slot").collect()]
    shards = write_shards(out.repartitionById(1 + out.agg({"shard": "max"}).first()[0], out.shard.cast("int")).sortWithinPartitions("slot"), f"file://{tmp_path}/shards").collect()
    assert sum(s.n for s in shards) == len(want)
    assert [r.tobytes() for r in read_slots(f"file://{tmp_path}/shards", len(want) // 2)] == want[len(want) // 2 :]


def test_no_documents(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_scratch_goes_with_its_stage(spark, tmp_path):
    from plumbline.llm.common import Scratch
    from plumbline.sources.shared import collected

    outer = Scratch(spark, "outer")
    with collected():
        inner = Scratch(spark, "inner")
        kept = outer.keep(inner.keep(spark.range(3)))
        path = inner.base
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert kept.count() == 3 and not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

"""The corpus pipeline: what is toxic, copied or leaked goes, sources are mixed, and token sequences come out in order.

Every stage takes (spark, docs, sf_dir) and returns a frame; run() writes each as Parquet to the shared folder and reads
it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import Scratch, table
from plumbline.llm.decontaminate import decontaminate
from plumbline.llm.mixing import mixed
from plumbline.llm.simhash import one_of_each
from plumbline.llm.token_output import training_order, vocabulary
from plumbline.llm.toxicity import without_toxic
from plumbline.sources.shared import collected


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score reaches the threshold go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays."""
    return one_of_each(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it: never, once or twice."""
    return mixed(docs)


def order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order, one partition for each shard."""
    return training_order(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaked),
    ("mixing", mix),
    ("token_output", order),
]

#: No SQL expresses the learned scores, the fingerprints' components or the balanced sample.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with collected():  # a stage's scratch goes as soon as its rows are written
            docs = scratch.keep(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            scratch.drop(before)
    return docs

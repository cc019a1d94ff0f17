"""Tables in the folder that driver and executors share, to cut the lineage of iterative work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write `df`, which may read from `path`, beside it, and put it in its place once it is whole."""
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(p(old), True)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    fs.delete(p(old), True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run in this block go at its end, else they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


_OWNERS: list[list[Scratch]] = []


@contextmanager
def collected() -> Iterator[None]:
    """What operators write as scratch in this block is removed at its end: their results must have been written by then."""
    made: list[Scratch] = []
    _OWNERS.append(made)
    try:
        yield
    finally:
        _OWNERS.pop()
        for scratch in made:
            scratch.clear()


class Scratch:
    """Tables written to the shared folder; `drop` removes those that no result needs any more, `clear` all.

    An operator's result reads from its scratch, so only who writes the result knows when that can go: see collected().
    """

    def __init__(self, spark: SparkSession, label: str):
        if _OWNERS:
            _OWNERS[-1].append(self)
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def keep(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """Write `df` once and return a reader of the written table; what the write shuffled goes once it is done."""
        path = self.path()
        with _shuffles_removed(self.spark):
            df.write.option("compression", codec).mode("overwrite").parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read.scratch_path = path
        return read

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, df.scratch_path)

    def clear(self) -> None:
        """Remove all tables, once what was made of them is written elsewhere."""
        delete(self.spark, self.base)

"""Subsystems from the paths of compiled files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S

# Folders at the top that are no subsystems.
EXCLUDED = (
    "arch",
    "scripts",
    "tools",
    "usr",
    "samples",
)


def classified(manifest: DataFrame, root: str, depth: int = 1, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """path, rel, key and why it doesn't count: outside, at the top, excluded; null if it does."""
    rel = S.make_relative(F.col("path"), root)
    out = manifest.select("path", rel.alias("rel")).withColumn("key", S.subsystem_key(F.col("rel"), depth))
    top = F.split("key", "/")[0]
    reason = F.when(F.col("rel").isNull(), "outside").when(F.col("key").isNull(), "no folder").when(top.isin(*excluded), "excluded")
    return out.withColumn("reason", reason)


def subsystems(manifest: DataFrame, root: str, depth: int = 1, min_files: int = 1, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """path, key, n, examples (three first paths in order) of each subsystem with enough files, by path."""
    fine = classified(manifest, root, depth, excluded).where("reason IS NULL")
    counted = fine.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_files)
    # Three examples by three minima, not by gathering a folder's paths.
    first = fine.groupBy("key").agg(F.min("rel").alias("a"))
    second = fine.join(first, "key").where("rel > a").groupBy("key", "a").agg(F.min("rel").alias("b"))
    third = fine.join(second, "key").where("rel > b").groupBy("key", "b").agg(F.min("rel").alias("c")).select("key", "c")
    named = counted.join(first, "key").join(second.select("key", "b"), "key", "left").join(third, "key", "left")
    return named.select(F.concat(F.lit(root.rstrip("/") + "/"), "key").alias("path"), "key", "n", F.array_compact(F.array("a", "b", "c")).alias("examples")).orderBy("path")


def skipped(manifest: DataFrame, root: str, depth: int = 1, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    return classified(manifest, root, depth, excluded).groupBy("reason").agg(F.count("*").alias("n")).where("reason IS NOT NULL")


def staged(manifest: DataFrame, root: str, key: str) -> DataFrame:
    """path and label, the flat name under which it is staged, of the manifest's files in a folder below `root`."""
    rel = S.make_relative(F.col("path"), root)
    return manifest.where(rel.startswith(key.strip("/") + "/")).select("path", S.label(F.col("path"), root).alias("label"))


def largest(found: DataFrame, n: int = 10) -> DataFrame:
    return found.select("key", "n").orderBy(F.desc("n"), "key").limit(n)

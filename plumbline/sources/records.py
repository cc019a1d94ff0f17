"""Readers and writers of record files. Files are read in order of their names, so results don't depend on a listing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from plumbline import schemas

#: Outputs that lie beside the units' files and are none of them.
RESERVED = ("gcc_merged.json", "nodes_all.json", "edges_all.json", "constants.json", "manifest.json", "compile_commands.json")

# Headers whose definitions win, in this order.
PRIORITY_HEADERS = (
    "include/uapi/linux/socket.h",
    "include/uapi/asm-generic/socket.h",
    "include/linux/socket.h",
    "include/uapi/linux/in.h",
    "include/uapi/linux/in6.h",
    "include/uapi/linux/net.h",
    "include/linux/net.h",
    "include/uapi/linux/if_ether.h",
    "include/uapi/linux/if_packet.h",
    "include/linux/fs.h",
    "include/uapi/linux/fcntl.h",
    "include/uapi/linux/mman.h",
    "include/uapi/linux/signal.h",
    "include/uapi/asm-generic/errno-base.h",
    "include/uapi/asm-generic/errno.h",
    "include/uapi/linux/errno.h",
    "include/uapi/linux/ioctl.h",
    "include/uapi/linux/capability.h",
    "include/uapi/linux/prctl.h",
    "include/uapi/linux/ptrace.h",
    "include/uapi/linux/stat.h",
    "include/uapi/linux/sched.h",
)


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def whole_files(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """path, name, size and text of each file."""
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), file_name().alias("name"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def parsed(files: DataFrame, schema: str) -> DataFrame:
    """name, bad (no JSON array) and records of each file; a bad file has no records.

    A value of a wrong type makes its field null, not its file bad.
    """
    kind = ArrayType(StructType.fromDDL(schema))
    text = F.trim("text")
    # An array that cannot be parsed gives null; an object or a scalar isn't an array though it may parse as one record.
    records = F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, kind, {"mode": "PERMISSIVE"}))
    whole = F.when(text == "[]", F.array().cast(kind)).otherwise(records)
    broken = whole.isNull() | ((text != "[]") & (F.coalesce(F.json_array_length(text), F.lit(-1)) != F.size(whole)))
    return files.select("name", F.when(broken, None).otherwise(whole).alias("records"), broken.alias("bad"))


def in_order(files: DataFrame, rank: Column | None = None) -> DataFrame:
    """One row per record, with its fields, unit (its file's name) and ord: files by rank, then name; records by place.

    Only files are numbered in one task, not records: ord is the file's number in the high bits, the place in the low.
    """
    numbered = files.withColumn("_file", F.row_number().over(Window.orderBy(rank if rank is not None else F.lit(0), "name")) - 1)
    each = numbered.select(F.col("name").alias("unit"), "_file", F.posexplode("records").alias("_at", "r"))
    return each.select("r.*", "unit", (F.shiftleft(F.col("_file").cast("long"), 32) + F.col("_at")).alias("ord"))


def unit_files(spark: SparkSession, folder: str, least: int = 0) -> DataFrame:
    """Files of translation units in `folder`, not below it: all JSON of `least` bytes but reserved outputs and node and edge files."""
    files = usable(whole_files(spark, folder, "*.json"), least)
    return files.where(~F.col("name").isin(*RESERVED) & ~F.col("name").startswith("nodes_") & ~F.col("name").startswith("edges_"))


def read_units(spark: SparkSession, folder: str, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """The compiler's records in order, and each file's name, bad and n."""
    read = parsed(unit_files(spark, folder, least), schemas.UNIT)
    return in_order(read.where(~F.col("bad"))), read.select("name", "bad", F.coalesce(F.size("records"), F.lit(0)).alias("n"))


def read_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Records of nodes_*.json but the union itself. Without any such file it fails, as nothing can be built."""
    files = whole_files(spark, folder, "nodes_*.json").where("name <> 'nodes_all.json'")
    if files.isEmpty():
        raise FileNotFoundError(f"no node files in {folder}")
    return in_order(parsed(files, "nodeType string, " + schemas.merged(*schemas.NODES.values())).where(~F.col("bad")))


def read_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Records of edges_*.json but the union itself; none at all is an empty frame."""
    files = whole_files(spark, folder, "edges_*.json").where("name <> 'edges_all.json'")
    return in_order(parsed(files, "edgeType string, " + schemas.merged(*schemas.EDGES.values())).where(~F.col("bad")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path of every line, trimmed; blank lines are dropped; an empty manifest fails."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    if lines.isEmpty():
        raise ValueError(f"the manifest is empty: {path}")
    return lines


def read_headers(spark: SparkSession, root: str, below: str = "include/uapi") -> DataFrame:
    """header_line rows: path (relative), header_rank, line_no, text. Priority headers first, then all `.h` below `below`."""
    base = root.rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.h").text(f"{base}/include", wholetext=True)
    plain = base.split("://", 1)[-1].lstrip("/")
    relative = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:/+", ""), f"^{plain}/", "")
    rank = F.create_map(*(x for i, h in enumerate(PRIORITY_HEADERS) for x in (F.lit(h), F.lit(i))))[F.col("path")]
    found = files.select(relative.alias("path"), F.col("value").alias("text")).withColumn("priority", rank)
    found = found.where(F.col("priority").isNotNull() | F.col("path").startswith(below + "/"))
    lines = F.posexplode(F.split("text", "\r\n|\r|\n"))
    return found.select("path", F.coalesce("priority", F.lit(1000)).alias("header_rank"), lines.alias("line_no", "text"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Probe lines `HIT:<function>` or `TIMEOUT`, whatever stands before the mark: hit_fn, null for a timeout."""
    line = F.col("value")
    return spark.read.text(path).where(line.rlike(r"_?(HIT:\S+|TIMEOUT)")).select(F.when(line.contains("HIT:"), F.regexp_extract(line, r"HIT:(\S+)", 1)).alias("hit_fn"))


def usable(files: DataFrame, least: int = 1024) -> DataFrame:
    """Files that are large enough to be a whole input."""
    return files.where(F.col("size") >= least)


def has_success(spark: SparkSession, path: str) -> bool:
    """Whether a stage's table was written to its end, so that the stage can be skipped."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_stage(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write a stage's table unless it is there whole, and read it."""
    if force or not has_success(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_manifest(paths: DataFrame, folder: str) -> None:
    """Add paths (path) to a manifest, a folder of text files; writers need no lock, as each adds files of its own."""
    paths.select("path").where("path IS NOT NULL AND path <> ''").write.mode("append").text(folder)


def write_json(df: DataFrame, path: str, order: Iterable[str] = ()) -> None:
    """One JSON object a line; null fields are left out."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, order: Iterable[str]) -> None:
    """A folder of JSON arrays, one a file, in `order` over files and rows; null fields are left out.

    Rows are sorted in ranges, so a file is a range of them and no task holds more.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.to_json(F.struct(*df.columns))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(line.alias("line"))

    def arrays(batches):
        import pyarrow as pa

        begun = False
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"value": [("," if begun else "[") + rows[0], *("," + r for r in rows[1:])]})
                begun = True
        if begun:
            yield pa.RecordBatch.from_pydict({"value": ["]"]})

    sorted_.mapInArrow(arrays, "value string").write.mode("overwrite").text(path)

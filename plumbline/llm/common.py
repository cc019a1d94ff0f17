"""What the training-data operators share: tables, shared scratch space, Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.shared import Scratch, delete, shared_root  # noqa: F401

#: White space between words, as a byte set: space and the ASCII controls from tab to carriage return.
SPACE = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of `key`, from a stream that is sorted by it (null keys last or first alike)."""
    carry: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = t.column(key)
        end = k[-1].as_py()
        same = _tail(k)
        if same < t.num_rows:
            yield pa.concat_tables([*carry, t.slice(0, t.num_rows - same)]).combine_chunks()
            carry = [t.slice(t.num_rows - same)]
        elif carry and last != end:
            yield pa.concat_tables(carry).combine_chunks()
            carry = [t]
        else:
            carry.append(t)
        last = end
    if carry:
        yield pa.concat_tables(carry).combine_chunks()


def _tail(k: pa.ChunkedArray) -> int:
    """How many of the last values are equal."""
    a = k.combine_chunks()
    codes = a.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    other = np.flatnonzero(codes != codes[-1])
    return len(codes) - (int(other[-1]) + 1 if len(other) else 0)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold some 2 MB of text each, one row at least."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        offsets = text_bytes(batch.column(text))[1]
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(n, max(at + 1, end))
            yield batch.slice(at, end - at)
            at = end


def text_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows in them; nulls are empty."""
    if not pa.types.is_large_string(a.type):
        a = a.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]

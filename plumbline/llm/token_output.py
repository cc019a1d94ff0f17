"""Token-id output in training order.

Documents are sorted in ranges by id, then text. Their texts become token ids, cut into sequences of one length, and a
sequence's index is its place in that order, which depends on nothing but the rows. A keyed Feistel network permutes the
indices, walking along its cycles until it is back among them, so every sequence has its own global slot and slots run
without a gap. Sequences then move to the partition of their slot, one partition for each shard; in a shard sequence i
stands at byte i * stride, so a reader finds any slot by arithmetic and resumes where it stopped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, table, text_chunks

TOKENIZER_FOLDER = "/opt/tokenizers"
VOCABULARY, END = "byte_bpe_50k.tiktoken", 50256
#: The vocabulary's cut of a text into pieces: a fixed value that belongs to it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH, PER_SHARD, KEY, ROUNDS = 512, 16384, 0x5EED, 6
#: Words whose ids a task remembers.
MAX_CACHE = 300_000
_DTYPE = np.dtype("<u2")
#: The vocabulary's white space, and runs of it that its pattern's search would take too deep.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_BLANK = re.compile(rf"(?<!{_BLANK}){_BLANK}{{1000,}}")


def vocabulary(path: str = f"{TOKENIZER_FOLDER}/{VOCABULARY}") -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids of texts as little-endian 16-bit bytes. Words between single spaces are encoded once and remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        if max(ranks.values(), default=0) > 0xFFFF:
            raise ValueError("ids must fit in 16 bits")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> list[int]:
        """Ids of a text. A long run of white space is one piece, but for its last character where a word follows."""
        if len(text) < 1000:
            return self.encoding.encode_ordinary(text)
        out, at = [], 0
        for m in _LONG_BLANK.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def encode(self, text: str) -> bytes:
        # Pieces never run over a single space between two words, so such words can be encoded each for itself.
        if "  " in text or text[:1].isspace() or text[-1:].isspace() or not text:
            return np.array(self.whole(text), _DTYPE).tobytes()
        first, *rest = text.split(" ")
        known, out = self.known, [np.array(self.whole(first), _DTYPE).tobytes()]
        if len(known) > MAX_CACHE:
            known.clear()
        for w in rest:
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.whole(" " + w), _DTYPE).tobytes()
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


def sequences(docs: DataFrame, ranks: dict[bytes, int], end: int = END, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk (from 0), n_tokens, ids, part, row: each text's ids and `end`, in sequences of `length` ids filled up with `end`.

    n_tokens counts the ids before the filling. A null or empty text is one sequence that holds `end` alone. part and
    row say in which task and as which of its rows a sequence was made.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    stride = length * _DTYPE.itemsize
    mark = np.array([end], _DTYPE).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, made = Encoder(held.value).encode, TaskContext.get().partitionId(), 0
        for b in text_chunks(batches, most=1_000_000):
            at, chunk, n, ids = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                all_ = encode(t or "") + mark
                for k, x in enumerate(range(0, len(all_), stride)):
                    part = all_[x : x + stride]
                    at.append(i)
                    chunk.append(k)
                    n.append(len(part) // _DTYPE.itemsize)
                    ids.append(part + mark * (length - n[-1]))
            own = [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(chunk, pa.int32()), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array([task] * len(n), pa.int32()), pa.array(np.arange(made, made + len(n)))]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "chunk", "n_tokens", "ids", "part", "row"])
            made += len(n)

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(cut, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, chunk int, n_tokens int, ids binary, part int, row long")


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0 to n - 1, of the places in `index`."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= np.uint64(n))):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def training_order(docs: DataFrame, ranks: dict[bytes, int], key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every sequence in its place: slot, shard, at (its byte in the shard), doc_id, chunk, n_tokens, ids.

    A partition of the result holds one shard, in order of slots; every shard but the last is full. Slots depend on the
    key and on the documents' ids and texts, not on how the rows are dealt. Repeated rows are sequences each for itself;
    null ids come first; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    # Equal rows go by their place as read, so that many of them still spread; among them the order makes no difference.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = read.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", F.xxhash64("text"), "_at").sortWithinPartitions(*order)
    cut = sequences(placed, ranks, end, length)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name not in ("part", "row"))
    written = scratch.keep(cut, "zstd")
    counts = {r.part: r.n for r in written.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one for each partition
    first = np.zeros(max(counts, default=-1) + 2, np.int64)
    first[1:] = np.cumsum([counts.get(p, 0) for p in range(len(first) - 1)])
    total, stride = int(first[-1]), length * _DTYPE.itemsize
    start = spark.sparkContext.broadcast(first)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = feistel(start.value[b.column("part").to_numpy()] + b.column("row").to_numpy(), total, key)
            cols = [pa.array(slot), pa.array(slot // per_shard, pa.int64()), pa.array(slot % per_shard * stride), *(b.column(c) for c in ("doc_id", "chunk", "n_tokens", "ids"))]
            yield pa.RecordBatch.from_arrays(cols, ["slot", "shard", "at", "doc_id", "chunk", "n_tokens", "ids"])

    placed = written.mapInArrow(place, f"slot long, shard long, at long, {kinds}")
    return placed.repartitionById(max(1, -(-total // per_shard)), F.col("shard").cast("int")).sortWithinPartitions("slot")


def _store(folder: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    except (OSError, pa.ArrowInvalid) as e:
        raise ValueError(f"no store that binary shards can be written to: {folder}") from e


def write_shards(ordered: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """Write what training_order returns as shard-NNNNNN.bin of fixed stride; returns shard, first_slot, n, sha256.

    `folder` is a URI of a store that pyarrow writes to (file, s3, gs, abfs, hdfs) or a plain path that all executors
    mount. Where files can be moved, a shard is written beside its place and moved there at once; in an object store it
    is there once it is closed. So a task that runs twice leaves the same file.
    """
    store, to = _store(folder)
    store.create_dir(to, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, digest, n, first, f = None, hashlib.sha256(), 0, None, None
        store, to = _store(folder)
        moves = store.type_name in ("local", "hdfs")
        for b in batches:
            for shard, slot, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "slot", "ids")), strict=True):
                if f is None:
                    own, first, name = shard, slot, f"{to}/shard-{shard:06d}.bin"
                    path = f"{to}/.{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}" if moves else name
                    f = store.open_output_stream(path)
                assert shard == own and slot == first + n and len(ids) == length * _DTYPE.itemsize
                f.write(ids)
                digest.update(ids)
                n += 1
        if f is not None:
            f.close()
            if moves:
                store.move(path, name)
            yield pa.RecordBatch.from_pydict({"shard": [own], "first_slot": [first], "n": [n], "sha256": [digest.hexdigest()]})

    return ordered.mapInArrow(write, "shard long, first_slot long, n long, sha256 string")


def read_slots(folder: str, slot: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The sequences from `slot` on, in order."""
    from pyarrow import fs

    (store, to), stride = _store(folder), length * _DTYPE.itemsize
    shard, at = divmod(slot, per_shard)
    while store.get_file_info(path := f"{to}/shard-{shard:06d}.bin").type == fs.FileType.File:
        with store.open_input_file(path) as f:
            f.seek(at * stride)
            while len(ids := f.read(stride)) == stride:
                yield np.frombuffer(ids, _DTYPE)
        shard, at = shard + 1, 0


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"), vocabulary())

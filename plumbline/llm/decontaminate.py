"""Benchmark decontamination: a broadcast hash set of the items' word windows, scanned for in whole texts.

Texts and items are cut into words of letters, digits and characters beyond ASCII, with A-Z in lower case. A window is
`width` consecutive words of an item, or all words of a shorter item. Every text is scanned once: rolling hashes of its
windows are looked up in the set, and each hit is verified word by word before it counts.

The set is broadcast only within `max_windows` and `max_bytes`. Beyond them the texts' window hashes are joined with the
items', which has no such bound; the few that are left meet the windows' words and are verified in the same way.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Scratch, table, text_bytes, text_chunks
from plumbline.llm.words import ALNUM, find_words, window_hashes

WIDTH = 10
#: What may be broadcast: windows, and bytes in memory.
MAX_WINDOWS, MAX_BYTES = 400_000, 64_000_000
_CHUNK = 1_000_000
_VALUES = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def item_windows(items: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows of the items: size, hash, words (joined by spaces), item_id as a string."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, most=_CHUNK):
            w = find_words(*text_bytes(b.column("text")), ALNUM)
            h, low, ids = w.hashes(), w.low.tobytes(), b.column("item_id").to_pylist()
            made = dict(window_hashes(h, width))
            out: list[tuple] = []
            first = np.concatenate([[0], np.cumsum(w.n)])
            for t, n in enumerate(w.n.tolist()):
                size = min(n, width)
                for i in range(first[t], first[t] + n - size + 1) if n else ():
                    words = b" ".join(low[w.start[j] : w.end[j]] for j in range(i, i + size))
                    out.append((size, int(_signed(made[size][i : i + 1])[0]), words, ids[t]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["size", "hash", "words", "item_id"])

    read = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return read.mapInArrow(cut, "size int, hash long, words binary, item_id string").distinct()


class WindowSet:
    """The windows in a few arrays: by size their hashes in order, their words in one run of bytes, and their items."""

    def __init__(self, t: pa.Table):
        """t: size, hash, words and item_id of each window and item."""
        t = t.sort_by([(c, "ascending") for c in ("size", "hash", "words")]).combine_chunks()
        size, h, words = t["size"].to_numpy(), t["hash"].to_numpy(), t["words"].to_pylist()
        new = np.array([i == 0 or (size[i], h[i], words[i]) != (size[i - 1], h[i - 1], words[i - 1]) for i in range(len(words))], bool)
        at = np.flatnonzero(new)
        own = [words[i] for i in at.tolist()]
        self.words = b"".join(own)
        self.ends = np.cumsum([0, *map(len, own)])
        self.names = pa.array(t["item_id"].to_pylist(), pa.string()).dictionary_encode()
        self.items = np.append(at, len(words))  # where each window's items begin among the names
        order = h[at].view(np.uint64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for s in np.unique(size[at]).tolist():
            mine = np.flatnonzero(size[at] == s)
            mine = mine[np.argsort(order[mine], kind="stable")]
            self.by_size[s] = (order[mine], mine)
        #: A bit table of the first bits of all hashes, which lets few others through.
        self.bits = np.zeros(1 << 22, bool)
        self.bits[order >> np.uint64(42)] = True

    def nbytes(self) -> int:
        arrays = [self.ends, self.items, self.bits, *(x for pair in self.by_size.values() for x in pair)]
        return len(self.words) + self.names.nbytes + sum(a.nbytes for a in arrays)

    def _items(self, k: int) -> list:
        return self.names.slice(self.items[k], self.items[k + 1] - self.items[k]).to_pylist()

    def hits(self, w) -> Iterator[tuple[int, int, list]]:
        """(word, size, items) of each window that occurs, in `w`."""
        if not self.by_size:
            return
        low = None
        for size, h in window_hashes(w.hashes(), max(self.by_size)):
            if size not in self.by_size:
                continue
            at = np.flatnonzero(self.bits[h >> np.uint64(42)])
            at = at[w.row[at] == w.row[at + size - 1]]
            known, window = self.by_size[size]
            first, last = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            for j in np.flatnonzero(first < last).tolist():
                low, i = w.low.tobytes() if low is None else low, int(at[j])
                words = _joined(low, w, i, size)
                for k in window[first[j] : last[j]].tolist():
                    if words == self.words[self.ends[k] : self.ends[k + 1]]:
                        yield i, size, self._items(k)


def _joined(low: bytes, w, i: int, size: int) -> bytes:
    return b" ".join([low[a:b] for a, b in zip(w.start[i : i + size].tolist(), w.end[i : i + size].tolist(), strict=True)])


def _scan(w, hits) -> tuple[np.ndarray, list[set]]:
    """Which words are hit, and each text's items."""
    change, items = np.zeros(len(w.start) + 1, np.int64), [None] * len(w.n)
    for i, size, own in hits:
        change[i] += 1
        change[i + size] -= 1
        t = w.row[i]
        if items[t] is None:
            items[t] = set()
        items[t].update(own)
    return np.cumsum(change[:-1]) > 0, items


def _digest(items: set | None) -> tuple[int, str]:
    own = sorted(x for x in items or () if x is not None)
    return len(own), hashlib.sha256(",".join(own).encode()).hexdigest()


def _spans(w, hit: np.ndarray) -> list[list[tuple[int, int]]]:
    """Each text's runs of hit words, as byte offsets in the chunk."""
    out: list[list[tuple[int, int]]] = [[] for _ in w.n]
    at = np.flatnonzero(hit)
    if len(at):
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(w.row[at]) > 0)])
        last = np.concatenate([at[np.flatnonzero(new)[1:] - 1], at[-1:]])
        for a, b in zip(at[new].tolist(), last.tolist(), strict=True):
            out[w.row[a]].append((int(w.start[a]), int(w.end[b])))
    return out


def _measure(ids: pa.Array, w, hit: np.ndarray, items: list) -> pa.RecordBatch:
    n_hit = np.bincount(w.row[hit], minlength=len(w.n))
    digests = [_digest(x) for x in items]
    cols = [ids, pa.array(w.n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests]), pa.array(n_hit > 0)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _window_set(spark: SparkSession, windows: DataFrame, max_windows: int, max_bytes: int):
    """A broadcast set, or None if it is beyond the bounds."""
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("words") + F.coalesce(F.length("item_id"), F.lit(0))), F.lit(0))).first()
    if n > max_windows or size > max_bytes:  # before anything comes to the driver
        return None
    made = WindowSet(windows.toArrow())
    return spark.sparkContext.broadcast(made) if made.nbytes() <= max_bytes else None


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit. items_sha256 digests the ids of the items that occur, as strings,
    sorted, joined by commas; of none it digests the empty string. A null or empty text has no words and no hit; an item
    without words has no window; the windows of an item without an id hit words but name no item. Repeated rows give
    repeated results, repeated items count once. Other columns are ignored; an empty table gives an empty result, and
    without items nothing is hit.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    windows = scratch.keep(item_windows(items, width, item_id, item_text))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = _window_set(spark, windows, max_windows, max_bytes)
    schema = f"doc_id {read.schema['doc_id'].dataType.simpleString()}, {_VALUES}"
    if known is None:
        return _by_join(scratch, read, windows, width, schema)
    scratch.drop(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, most=_CHUNK):
            w = find_words(*text_bytes(b.column("text")), ALNUM)
            yield _measure(b.column("doc_id"), w, *_scan(w, known.value.hits(w)))

    return read.mapInArrow(scan, schema)


def _by_join(scratch: Scratch, read: DataFrame, windows: DataFrame, width: int, schema: str) -> DataFrame:
    """The same without a broadcast: each text's window hashes meet the items' in a join.

    Rows go by a key of their own: their place in the table as written once.
    """
    rows = scratch.keep(read.withColumn("row", F.monotonically_increasing_id()))
    joined = rows.join(_found(scratch, rows.select("row", "text"), windows, width), "row", "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, most=_CHUNK):
            w = find_words(*text_bytes(b.column("text")), ALNUM)
            yield _measure(b.column("doc_id"), w, *_scan(w, _verified(w, b.column("hits"))))

    return joined.select("doc_id", "text", "hits").mapInArrow(scan, schema)


def _verified(w, hits: pa.Array) -> Iterator[tuple[int, int, list]]:
    """(word, size, items) of each window that occurs, from each text's own places and the windows with their hashes."""
    first, low = np.concatenate([[0], np.cumsum(w.n)]), w.low.tobytes()
    for t, own in enumerate(hits.to_pylist()):
        for x in own or ():
            i = int(first[t]) + x["at"]
            words = _joined(low, w, i, x["size"])
            for known in x["windows"]:
                if known["words"] == words:
                    yield i, x["size"], known["items"] or [None]


def _found(scratch: Scratch, rows: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """row and hits (at, size, windows with the hash) of the rows (row, text) whose window hashes the items have."""
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # `width` values at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, most=_CHUNK // 4):
            w = find_words(*text_bytes(b.column("text")), ALNUM)
            row = b.column("row").to_numpy()
            first = np.concatenate([[0], np.cumsum(w.n)])[:-1]
            for size, h in window_hashes(w.hashes(), width):
                if size in sizes:
                    at = np.arange(len(h))
                    at = at[w.row[at] == w.row[at + size - 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(row[w.row[at]]), pa.array(at - first[w.row[at]], pa.int64()), pa.array(_signed(h[at])), pa.array([size] * len(at), pa.int32())], ["row", "at", "hash", "size"])

    seen = rows.mapInArrow(emit, "row long, at long, hash long, size int")
    known = windows.select("size", "hash").distinct()
    hit = scratch.keep(seen.join(known, ["size", "hash"], "left_semi"))
    # The items of a window in one list: it holds no more ids than the benchmark has items with that window.
    meaning = windows.groupBy("size", "hash", "words").agg(F.collect_set("item_id").alias("items"))
    meaning = scratch.keep(meaning.groupBy("size", "hash").agg(F.collect_list(F.struct("words", "items")).alias("windows")))
    found = hit.join(meaning, ["size", "hash"]).groupBy("row").agg(F.collect_list(F.struct("at", "size", "windows")).alias("hits"))
    return scratch.keep(found)


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", width: int = WIDTH, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES, join_beyond: bool = True) -> DataFrame:
    """`docs` with its own columns, without what the items leak into it.

    mode "documents" leaves out every row with a hit word; mode "spans" keeps all rows and cuts each run of hit words
    out of the text. Rows without a hit stay as they are, null texts among them. Items beyond the broadcast
    bounds are found by the join that contamination() uses; without join_beyond they raise ValueError.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.keep(item_windows(items, width, item_id, item_text))
    known = _window_set(docs.sparkSession, windows, max_windows, max_bytes)
    joined = known is None
    if joined and not join_beyond:
        raise ValueError("the items are beyond the broadcast bounds")
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, text=at, most=_CHUNK):
            data, offsets = text_bytes(b.column(at))
            w = find_words(data, offsets, ALNUM)
            if joined:  # the last column holds the hits
                hit, _ = _scan(w, _verified(w, b.column(b.num_columns - 1)))
                b = b.select(list(range(b.num_columns - 1)))
            else:
                hit, _ = _scan(w, known.value.hits(w))
            if mode == "documents":
                yield b.filter(pa.array(np.bincount(w.row[hit], minlength=len(w.n)) == 0))
                continue
            raw, texts = data.tobytes(), b.column(at).to_pylist()
            for t, spans in enumerate(_spans(w, hit)):
                if spans:
                    cuts = [offsets[t], *(x for s in spans for x in s), offsets[t + 1]]
                    texts[t] = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)).decode()
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    if joined:
        rows = scratch.keep(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")))
        found = _found(scratch, rows.select("row", F.col("doc")[text].alias("text")), windows, width)
        return rows.join(found, "row", "left").select("doc.*", "hits").mapInArrow(clean, docs.schema)
    scratch.drop(windows)
    return docs.mapInArrow(clean, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_OP1 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
seen AS (
  SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, seen.size AS size, item_id FROM seen JOIN win USING (words)),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r),
m AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
      FROM hits WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""

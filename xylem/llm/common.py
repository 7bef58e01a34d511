"""Helpers shared by the training-data operators.

Words are the byte runs between the white space bytes 0x20 and 0x09-0x0D.  A whole Arrow batch is cut and hashed by
numpy, so no operator loops over words in Python.  A word's name is a 64-bit hash of its bytes.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


try:  # large arrays go back to the system when they are freed, whatever was freed before
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 4 << 20)
except (AttributeError, OSError):  # another C library
    _libc = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_ODD))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, _CHUNK + 1)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["up"], _powers["down"]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offset of each row in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int = _CHUNK):
    """Ranges of rows of about `most` bytes; a longer row is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def cut_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the offset of each row in these."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (edge[:-1] | ~before))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(column, lower: bool = False):
    """Yields for ranges of rows: first row, row offsets, word hashes, start and end bytes of the words, the bytes."""
    data, off = text_bytes(column)
    for i, j in blocks(off):
        part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, rows = cut_words(part, at)
        yield i, rows, hash_spans(part, starts, ends, lower), starts, ends, part


class Places:
    """Rows of 64-bit keys: an open hash table, at most a quarter full, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.row = np.full(1 << self.bits, -1, np.int32)
        self.key = np.full(1 << self.bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = self.row[slot] < 0
            self.row[slot[free]] = left[free]  # of several for one slot the last stays
            put = self.row[slot] == left
            self.key[slot[put]] = keys[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        slot = self.slots(keys)
        out = np.where(self.key[slot] == keys, self.row[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.row[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = slot[open_]
            hit = self.key[at] == keys[open_]
            out[open_[hit]] = self.row[at[hit]]
            open_ = open_[~hit & (self.row[at] >= 0)]
        return out


class Tally:
    """Counts by 64-bit name, gathered over a task's batches so that a task gives each name once; gives out early what passes
    `most` names, which bounds its memory and only adds rows to sum."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.names, self.counts, self.size = most, [], [], 0

    def put(self, names: np.ndarray, counts: np.ndarray | None = None) -> bool:
        """Takes names in; tells whether there are so many that they must be given out."""
        if len(names):
            self.names.append(names)
            self.counts.append(np.ones(len(names), np.int64) if counts is None else counts)
            self.size += len(names)
        if self.size > 2 * self.most:
            self.merge()
        return self.size > self.most and len(self.names) == 1

    def add(self, names: np.ndarray, counts: np.ndarray | None = None):
        if self.put(names, counts):
            yield from self.rest()

    def merge(self) -> None:
        names = np.concatenate(self.names)
        order = np.argsort(names)
        names, counts = names[order], np.concatenate(self.counts)[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        self.names, self.counts, self.size = [names[first]], [np.add.reduceat(counts, first)], len(first)

    def clear(self) -> None:
        self.names, self.counts, self.size = [], [], 0

    def rest(self):
        """Arrow batches (name, n)."""
        if self.size:
            self.merge()
            names, counts = self.names[0].view(np.int64), self.counts[0]
            for i in range(0, len(names), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["name", "n"])
        self.clear()


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on from task to task and from stage to stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow whose tasks give back their memory at their end."""
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def row_key(*columns: str) -> Column:
    """A 64-bit name of the row's content: equal rows are equal documents and get equal results."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns], F.lit(17))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share: spark.checkpoint.dir; where it is unset, a local one on a single machine, an error on a cluster."""
    sc = spark.sparkContext
    top = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set, and executors share no folder otherwise")
        top = "/tmp/xylem-checkpoint"
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, as rows may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))

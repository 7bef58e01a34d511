"""Packing documents into training sequences: shortest-pack-first over the length histogram.

1. `token_pieces`: each document becomes its token ids and an end id, cut into full sequences and a rest.  With a `grain`
   below the size, a longer rest is cut once more, so that its first piece is a multiple of it; corpora with
   few different lengths pad less then.
2. The histogram of piece lengths (at most `size` bins, whatever the corpus) goes to the driver.  `plan_packs` places
   lengths longest first, each into the shortest pack that exists, and updates how often each packing pattern occurs.
3. Pieces of one length are numbered 0, 1, 2, ... over the cluster: by row_number within (length, bucket), plus the counts
   of the buckets before, so that no length is numbered by a single task.  A pattern that occurs m times takes the
   next m numbers of each of its lengths, and so pieces meet their sequences by number.

Nulls and empty texts are the end id alone.  Repeated rows are packed each for itself.  An empty table gives an empty one.
Other columns are not read.  Equal pieces may swap places between runs; all else is fixed.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, settle, small_batches
from .tokens import encoder

SIZE, END_ID, GRAIN = 2048, 1, 2048


def cut_lengths(n: int, size: int = SIZE, grain: int = GRAIN) -> list[int]:
    full, rest = divmod(n, size)
    out = [size] * full
    if rest > grain and rest % grain:
        out.append(rest - rest % grain)
        rest %= grain
    if rest:
        out.append(rest)
    return out


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", size=SIZE, grain=GRAIN, end_id=END_ID, with_ids=True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens and (with_ids) ids as little-endian 32-bit numbers."""
    small_batches(docs.sparkSession)
    schema = f"k {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    names = ["k", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches):
        enc = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, at, ids in enc.encode(batch.column(1)):
                raw, row, cols = memoryview(ids.astype("<u4").tobytes()), [], [[] for _ in range(5)]
                edges = (at * 4).tolist()
                for r in range(len(at) - 1):
                    whole = bytes(raw[edges[r] : edges[r + 1]]) + end
                    start = 0
                    for n in cut_lengths(len(whole) // 4, size, grain):
                        piece = whole[start * 4 : (start + n) * 4]
                        row.append(first + r)
                        for c, v in zip(cols, (start, n, zlib.crc32(piece), len(whole) // 4, piece), strict=True):
                            c.append(v)
                        start += n
                arrays = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:4]]]
                if with_ids:
                    arrays.append(pa.array(cols[4], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        enc.thin()  # the worker lives on: only what came again is kept for the next task

    return docs.select(id_col, text_col).transform(mapped, run, schema).withColumnRenamed("k", id_col)


def plan_packs(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Packing patterns: how often each occurs, and its lengths in the order of their places."""
    groups: dict[int, list[list]] = defaultdict(list)  # used length -> [count, (last length, rest of the pattern)]
    used: list[int] = []  # heap of used lengths, shortest pack first
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and used and used[0] + length <= size:
            at = used[0] + length
            pack = groups[used[0]][-1]
            take = min(left, pack[0])
            left -= take
            pack[0] -= take
            if not pack[0]:
                groups[used[0]].pop()
                if not groups[used[0]]:
                    heapq.heappop(used)
            if not groups[at]:
                heapq.heappush(used, at)
            groups[at].append([take, (length, pack[1])])
        each = size // length
        if left:
            for n, times in ((each, left // each), (left % each, 1)):
                if n and times:
                    pattern = None
                    for _ in range(n):
                        pattern = (length, pattern)
                    if not groups[n * length]:
                        heapq.heappush(used, n * length)
                    groups[n * length].append([times, pattern])
    out = []
    for at in sorted(groups, reverse=True):
        for count, chain in groups[at]:
            lengths = []
            while chain:
                lengths.append(chain[0])
                chain = chain[1]
            out.append((count, lengths[::-1]))
    return out


def pack_slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first number of each run of its pieces, the run's first sequence, the offset there."""
    taken: dict[int, int] = defaultdict(int)
    slots: dict[int, list] = defaultdict(list)
    base = 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            slots[n].append((taken[n], base, offset))
            taken[n] += count
            offset += n
        base += count
    return {n: tuple(np.array(x, np.int64) for x in zip(*s, strict=True)) for n, s in slots.items()}


def pack(pieces: DataFrame, id_col="doc_id", size=SIZE, name="packing") -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    spark = pieces.sparkSession
    pieces = settle(pieces, name)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    sent = spark.sparkContext.broadcast(pack_slots(plan_packs(counts, size)))  # bounded by the number of lengths
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(buckets)))
    before = dealt.groupBy("length", "_b").count().select("length", "_b", (F.sum("count").over(Window.partitionBy("length").orderBy("_b")) - F.col("count")).alias("_before"))
    ranked = dealt.join(before, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_b").orderBy("ids_crc32", id_col, "start")) - 1)
    ranked = ranked.select(*pieces.columns, "_rank")
    n, at_length, at_rank = len(pieces.columns), ranked.columns.index("length"), ranked.columns.index("_rank")
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches):
        slots = sent.value
        for b in batches:
            length, rank = b.column(at_length).to_numpy(), b.column(at_rank).to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                begin, base, off = slots[int(x)]
                k = np.searchsorted(begin, rank[rows], "right") - 1
                seq[rows], offset[rows] = base[k] + rank[rows] - begin[k], off[k]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], pa.array(seq), pa.array(offset)], names=schema.names)

    return ranked.transform(mapped, run, schema)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_packing_spfhp(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, public_tokenizer(), with_ids=False))


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: sequences of the documents that are left."""
    return pack(token_pieces(docs, public_tokenizer(), with_ids=False), name="pipeline-packing")

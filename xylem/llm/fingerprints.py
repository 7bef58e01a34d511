"""Document fingerprints: one-permutation MinHash, densified and packed, with native column functions only.

Each run of five words is hashed once; the top seven bits choose one of 128 bins, which keeps its least hash.  An empty bin b takes
the value of the first filled bin in an order of its own (a pseudo-random permutation for each b, the same for all documents:
optimal densification).  The low eight bits of each bin are stored.  Two bins of different documents agree by chance
once in 256, so that the share p of equal bins estimates the likeness (p - C) / (1 - C) with C = 1/256.

A fingerprint is a column expression on one row: nothing is shuffled, and equal texts have equal fingerprints.

Nulls: a null text is empty.  Texts under five words are one shingle of all their words; texts without words are equal to each other.
`edited_pairs` takes rows by descending id, then content; rows with equal id and text are one document with equal results; null ids
come last.  A single document is its own next.  An empty table gives an empty one.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, settle

BINS_LOG, BITS, WIDTH = 7, 8, 5
BINS = 1 << BINS_LOG
_PROBES = 4


def probe_place(b: Column, t: Column) -> Column:
    """The t-th bin where bin b looks for a value.  Multiplication by an odd number and exclusive or permute the bins, so
    that t from 0 to BINS - 1 meets every one; all three numbers come from a hash of b."""
    h = F.xxhash64(b)
    part = lambda i: F.shiftright(h, i * BINS_LOG).bitwiseAND(BINS - 1).cast("int")
    return F.pmod(part(0).bitwiseOR(F.lit(1)) * t + part(1), F.lit(BINS)).bitwiseXOR(part(2))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(word_list: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of the runs of `width` words; xxhash64 passes over what lies beyond the end of a short text."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(word_list) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(word_list, i + k) for k in range(width)]))


def bin_minima(sorted_hashes: Column) -> Column:
    """Array of BINS values, null for empty bins.  The order by hash is the order by bin, so a bin's least hash is its first."""
    bin_of = lambda x: F.shiftright(x, 64 - BINS_LOG).cast("int") + BINS // 2
    firsts = F.filter(sorted_hashes, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(sorted_hashes, i - 1))))
    start = F.array().cast("array<bigint>")
    none = F.lit(None).cast("bigint")
    laid = F.aggregate(firsts, start, lambda acc, x: F.concat(acc, F.array_repeat(none, bin_of(x) - F.size(acc)), F.array(x)), lambda acc: F.concat(acc, F.array_repeat(none, F.lit(BINS) - F.size(acc))))
    return laid


def densify(minima: Column) -> Column:
    probe = lambda b, t: F.get(minima, probe_place(b, t))
    rest = lambda b: F.get(F.filter(F.transform(F.sequence(F.lit(_PROBES), F.lit(BINS - 1)), lambda t: probe(b, t)), lambda v: v.isNotNull()), 0)
    return F.transform(minima, lambda v, b: F.coalesce(v, *[probe(b, F.lit(t)) for t in range(_PROBES)], rest(b)))


def low_bits(values: Column) -> Column:
    return F.transform(values, lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))


def to_hex(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    chance = 1 / (1 << BITS)
    p = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / BINS
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p - chance) / (1 - chance)))


def fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds `out`, an array of BINS numbers of BITS bits.  Each step is a projection of its own, so that it is computed once."""
    df = df.withColumn("_w", words(F.col(text_col)))
    df = df.withColumn("_h", F.sort_array(shingle_hashes(F.col("_w")))).drop("_w")
    df = df.withColumn("_m", bin_minima(F.col("_h"))).drop("_h")
    return df.withColumn(out, low_bits(densify(F.col("_m")))).drop("_m")


def pack(codes: Column) -> Column:
    """The stored form: BINS bytes."""
    return F.unhex(to_hex(codes))


def next_documents(ids: DataFrame) -> DataFrame:
    """ids (_key, _id): adds _next, the key after it by descending id; the last one's is the first.

    Rows are dealt by range; within a range the next row is a window away, and the rows that end a range take the head of the next
    range from a table with one row per range."""
    spark = ids.sparkSession
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("_id").desc_nulls_last(), F.col("_key").desc()]
    dealt = ids.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    within = Window.partitionBy("_p").orderBy(*order)
    rows = dealt.withColumn("_next", F.lead("_key").over(within)).withColumn("_first", F.row_number().over(within) == 1)
    heads = rows.where("_first").select("_p", F.col("_key").alias("_head"))
    turn = Window.orderBy("_p")
    heads = heads.select("_p", F.coalesce(F.lead("_head").over(turn), F.first("_head").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    return rows.join(heads, "_p", "left").select("_key", "_id", F.coalesce("_next", "_after").alias("_next"))


def edited_pairs(docs: DataFrame, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """Fingerprints of each document and of its edited text, whose last third is replaced by the beginning of the next document,
    by key; and the table of keys, ids and next keys.

    The texts are shuffled once: both joins read the same columns dealt in the same way, so that Spark uses the exchange again."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), row_key(id_col, text_col).alias("_key"))
    ids = base.select("_key", "_id", F.length("_text").alias("_n")).groupBy("_key").agg(F.first("_id").alias("_id"), F.first("_n").alias("_n"))
    ids = settle(ids, "document-keys")
    follow = settle(next_documents(ids.select("_key", "_id")), "next-documents")
    dealt = base.select("_key", "_text").repartition(parts, "_key")
    asked = follow.join(ids.select("_key", "_n"), "_key").select(F.col("_next").alias("_key"), F.col("_key").alias("_for"), F.floor(F.col("_n") / 3).cast("int").alias("_take"))
    given = asked.join(dealt, "_key").groupBy("_for").agg(F.first(F.substr("_text", F.lit(1), "_take")).alias("_new"))
    whole = dealt.join(given.withColumnRenamed("_for", "_key"), "_key", "left")
    n = F.length("_text")
    whole = whole.withColumn("_edited", F.concat(F.substr("_text", F.lit(1), (n - F.floor(n / 3)).cast("int")), F.coalesce("_new", F.lit(""))))
    both = fingerprint(fingerprint(whole.withColumn("n_chars", n.cast("long")), "_text", "_own"), "_edited", "_other")
    return both.select("_key", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "_own", "_other"), follow


def op8_minhash_oph(spark, sf_dir: str) -> DataFrame:
    both, follow = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    both = settle(both, "fingerprints")
    one = both.groupBy("_key").agg(F.first("_own").alias("_theirs")).withColumnRenamed("_key", "_next")
    near = follow.join(one, "_next").select("_key", "_id", "_theirs")
    return both.join(near, "_key").select(
        F.col("_id").alias("doc_id"), "n_chars", "edited_sha256",
        to_hex(F.col("_own")).alias("fingerprint"), to_hex(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"), likeness(F.col("_own"), F.col("_theirs")).alias("near_next"),
    )

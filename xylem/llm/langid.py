"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to `ORDER` bytes is learned with the counts and escape probabilities of method C:
a seen byte costs -log2 n/(t+d), an escape to the next shorter context -log2 d/(t+d), with n the byte's count, t the
context's and d its number of different bytes; below the empty context all 256 bytes are alike.  The statistics are then frozen, so that
the code length of a whole text is a sum of table entries: for each order a hash table of the grams seen in any language, with
their costs in each, and the cost of an escape for those that are contexts.  The language with the shortest code wins.

Learned from a bounded sample: about `rows_per_language` rows of each language, chosen by a hash of the id.
The score is the winner's share among exp(-code length), with the evidence of longer texts scaled down to that of 64 bytes.

Nulls: a null text, or one without a letter, is `und` with score 0; rows with null lang are not learned from; rows with
null id are never learned from.  Ties go to the language that sorts first.  Repeated rows get equal values.  Without any
row to learn from all are `und`.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Places, blocks, mapped, small_batches, text_bytes

ROWS_PER_LANGUAGE = 600
MAX_LANGUAGES = 512
ORDER = 3
DENSE = 1  # orders up to this are tables of all grams
_BLOCK = 1 << 17


def gram_keys(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """For each byte of the texts the number of its gram: itself and the `order` bytes before it; zeros stand before a text."""
    key = data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.int64)
        before[k:] = data[:-k]
        before[place < k] = 0
        key += before << (8 * k)
    return key


@dataclass
class PpmModel:
    langs: list[str]
    dense: np.ndarray  # [256^(DENSE + 1), languages]: costs of the grams of order DENSE
    keys: list[np.ndarray]  # for each order from DENSE + 1: the grams seen in any language
    costs: list[np.ndarray]  # their costs [grams, languages]
    escapes: list[np.ndarray]  # for each order from DENSE: cost of the escape from each gram as a context of the order above

    def code_lengths(self, data: np.ndarray, off: np.ndarray, places: list[Places] | None = None) -> np.ndarray:
        """Bits of each row under each language."""
        places = places or self.places()
        out = np.zeros((len(off) - 1, len(self.langs)))
        top = DENSE + len(self.keys)
        for i, j in blocks(off, _BLOCK):
            part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            if not len(part):
                continue
            key = gram_keys(part, at, top)
            row = places[-1].find(key)
            cost = self.costs[-1][row]
            miss = np.flatnonzero(row < 0)
            cost[miss] = 0
            for order in range(top, DENSE, -1):  # the grams not seen at this order: an escape, and one order less
                if not len(miss):
                    break
                k = order - DENSE - 1
                context = key[miss] >> 8 & ((1 << (8 * order)) - 1)
                shorter = key[miss] & ((1 << (8 * order)) - 1)
                if k:
                    seen = places[k - 1].find(context)
                    cost[miss[seen >= 0]] += self.escapes[k][seen[seen >= 0]]
                    row = places[k - 1].find(shorter)
                    cost[miss[row >= 0]] += self.costs[k - 1][row[row >= 0]]
                    miss = miss[row < 0]
                else:
                    cost[miss] += self.escapes[0][context] + self.dense[shorter]
            full = np.flatnonzero(np.diff(at))
            out[i + full] = np.add.reduceat(cost, at[full], axis=0, dtype=np.float64)
        return out

    def places(self) -> list[Places]:
        return [Places(k) for k in self.keys]


def train_ppm(samples: dict[str, list[str]], order: int = ORDER) -> PpmModel:
    """order: bytes of the longest context, from DENSE + 1 to 6."""
    langs = sorted(samples)
    packed = [text_bytes(pa.array(samples[x], pa.string())) for x in langs]
    grams = [[np.unique(gram_keys(*p, k), return_counts=True) for p in packed] for k in range(order + 1)]

    def statistics(k: int, x: int):
        """Of order k in language x: grams, their costs as seen, contexts, the cost of an escape from each."""
        keys, n = grams[k][x]
        context, where = np.unique(keys >> 8, return_inverse=True)
        t, d = np.bincount(where, n, len(context)), np.bincount(where, minlength=len(context))
        return keys, -np.log2(n / (t + d)[where]), context, -np.log2(d / (t + d))

    dense = np.full((256, len(langs)), 8.0)
    for k in range(DENSE + 1):
        if k:
            dense = np.tile(dense, (256, 1))
        for x in range(len(langs)):
            keys, seen, context, escape = statistics(k, x)
            wide = dense[:, x].reshape(256**k, -1)
            wide[context] += escape[:, None]
            dense[keys, x] = seen
    keys_of, costs, escapes = [], [], []
    below, find = np.arange(256 ** (DENSE + 1)), lambda k: k
    cost_below = dense
    for k in range(DENSE + 1, order + 1):
        keys = np.unique(np.concatenate([[0], *[g[0] for g in grams[k]]]))  # 0: the context of a first byte
        escape = np.zeros((len(below), len(langs)), np.float32)
        parts = [statistics(k, x) for x in range(len(langs))]
        for x, (_, _, context, bits) in enumerate(parts):
            escape[find(context), x] = bits  # a context was a gram of the order below
        cost = (escape[find(keys >> 8)] + cost_below[find(keys & ((1 << (8 * k)) - 1))]).astype(np.float32)
        for x, (own, seen, _, _) in enumerate(parts):
            cost[np.searchsorted(keys, own), x] = seen
        keys_of.append(keys)
        costs.append(cost)
        escapes.append(escape)
        below, cost_below = keys, cost
        find = lambda q, keys=keys: np.searchsorted(keys, q)
    return PpmModel(langs, dense.astype(np.float32), keys_of, costs, escapes)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> PpmModel | None:
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(~held_out("i") & F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = known.groupBy("l").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("l") == r["l"], F.lit(rows_per_language / r["count"])) for r in counts])
    drawn = (F.pmod(F.xxhash64(F.col("i"), F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share
    samples: dict[str, list[str]] = {}
    for r in known.where(drawn).limit(2 * rows_per_language * len(counts)).collect():
        samples.setdefault(r["l"], []).append(r["t"])
    return train_ppm(samples) if samples else None


def identify(docs: DataFrame, model: PpmModel | None, id_col="doc_id", text_col="text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (the id by default) of each row, with lang_pred and score."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [id_col] if keep is None else keep
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", lang_pred string, score double"
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        m = sent.value
        places = m.places()
        for batch in batches:
            data, off = text_bytes(batch.column(len(names)))
            bits = m.code_lengths(data, off, places)
            n = np.maximum(np.diff(off), 1)
            best = np.argmin(bits, axis=1) if len(bits) else np.zeros(0, np.int64)
            rel = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1, 64 / n)[:, None] if len(bits) else bits
            score = 1 / np.exp2(-rel).sum(axis=1)
            ok = batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
            pred = np.where(ok, np.array(m.langs, object)[best], "und")
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(pred, pa.string()), pa.array(np.where(ok, score, 0.0), pa.float64())], names=[*names, "lang_pred", "score"])

    out = rows.transform(mapped, run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "lang_pred", "score")


def op10_langid_ppm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage_langid(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined (no text, no letter) go."""
    out = identify(docs, fit(docs), keep=docs.columns)
    return out.where(F.col("lang_pred") != "und").select(*docs.columns)

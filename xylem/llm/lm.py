"""Language-model scoring with Brown classes.

Words are the byte runs between white space, A-Z as a-z; each text ends with one end token.  A word's name is its hash.

1. Counts of all training words over the cluster.
2. Every word has a class.  The `head` most frequent words have a place each in a table of classes, every other word one of 2^`tail_log`
   places by its hash, shared only by words that meet there by chance; the table is a byte a place and goes to all tasks.
3. Exchange clustering.  The `core` most frequent words begin: on the matrix of their bigrams each word in turn moves to the class that
   gains most likelihood, until a round moves few.  Then rounds over the whole training corpus move all places: with the counts of the
   classes before and after it, added up over the cluster, a place goes where the likelihood of the class bigrams grows most.
   A round counts under the classes of the round before, and is kept if the likelihood of all class bigrams has grown.
4. P(w | v) = (1 - a) P(class w | class v) P(w | class w) + a (c + 1) / (N + V + 1), with v the word before, or the text's start, and smoothed
   transitions, words that training never met being passed over; the second part leaves 1 / (N + V + 1) for every unknown word, so that the model is a distribution over words and one unknown.
5. Scoring: tokens among the head words are scored where they are read; the others go once through a join
   with the word counts, as (text, word, class before) rows, and sums by text come back.

Nulls: a null text is empty, one end token.  Rows with null id are training rows.  Rows of equal id and text get equal results, each in its
own row, and count each in training.  Without training rows N = V = 0 and scores are of the second part alone.  Ties
of counts go by hash, of classes by number.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _U, Places, Tally, hashed_words, mapped, mix, row_key, settle, small_batches

CORE, HEAD, TAIL_LOG, CLASSES, ROUNDS, CORPUS_ROUNDS = 1024, 1 << 16, 22, 24, 12, 3
MIX, ADD = 0.3, 0.1
END = 0x454E44  # the name of the end token


NO_CLASS = 255


@dataclass
class Lookup:
    """The most frequent words, sorted by name: name, count."""

    names: np.ndarray
    counts: np.ndarray
    places: Places | None = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each name, -1 if it is not here."""
        self.places = self.places or Places(self.names.view(np.int64))
        return self.places.find(h.view(np.int64)).astype(np.int64)


def training(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 != 2, F.lit(True))


def with_ends(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words and its end token, and the offsets of the texts."""
    n = len(rows) - 1
    out = np.empty(len(h) + n, np.uint64)
    ends = rows[1:] + np.arange(n)
    out[ends] = END
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = h
    return np.concatenate([[0], ends + 1]), out


def count_words(texts: DataFrame) -> DataFrame:
    """texts: one string column.  Rows (name, n) of all tokens."""
    def run(batches):
        tally = Tally()
        for b in batches:
            for _, rows, h, *_ in hashed_words(b.column(0), lower=True):
                yield from tally.add(*np.unique(with_ends(rows, h)[1], return_counts=True))
        yield from tally.rest()

    return texts.transform(mapped, run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))


def core_bigrams(texts: DataFrame, core: np.ndarray) -> np.ndarray:
    """How often each core word follows each, texts' starts included as a last row; names sorted."""
    k = len(core)

    def run(batches):
        table = np.zeros((k + 1, k), np.int64)
        look = Lookup(core, core)
        for b in batches:
            for _, rows, h, *_ in hashed_words(b.column(0), lower=True):
                rows, h = with_ends(rows, h)
                at = look.find(h)
                prev = np.empty(len(at), np.int64)
                prev[1:] = at[:-1]
                prev[rows[:-1]] = k
                both = (at >= 0) & (prev >= 0)
                table += np.bincount(prev[both] * k + at[both], minlength=(k + 1) * k).reshape(k + 1, k)
        flat = table.reshape(-1)
        full = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(flat[full])], names=["place", "n"])

    found = texts.transform(mapped, run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # core x core cells at most
    table = np.zeros((k + 1) * k, np.int64)
    table[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(k + 1, k)


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, frequency: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of the words of a bigram matrix, by the exchange algorithm on sum N(c,d) log N(c,d) - sum left(c) log left(c) - sum right(c) log right(c).

    A word leaves its class and goes where the sum grows most; begins with the words dealt by frequency."""
    k = len(frequency)
    b = bigrams[:k].astype(float)
    classes = min(classes, k)
    order = np.argsort(-frequency, kind="stable")
    of = np.zeros(k, np.int64)
    of[order] = np.arange(k) % classes
    onehot = np.eye(classes)[of]
    joint = onehot.T @ b @ onehot
    left, right = joint.sum(1), joint.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in order:
            c = of[w]
            out, into, own = np.bincount(of, b[w], classes), np.bincount(of, b[:, w], classes), b[w, w]
            out[c] -= own
            into[c] -= own
            lw, rw = out.sum() + own, into.sum() + own
            joint[c] -= out
            joint[:, c] -= into
            joint[c, c] -= own
            left[c] -= lw
            right[c] -= rw
            rows = (_xlogx(joint + out) - _xlogx(joint)).sum(1)
            cols = (_xlogx(joint.T + into) - _xlogx(joint.T)).sum(1)
            d = np.arange(classes)
            diag = joint[d, d]
            both = _xlogx(diag + out + into + own) - _xlogx(diag + out) - _xlogx(diag + into) + _xlogx(diag)
            gain = rows + cols + both - _xlogx(left + lw) + _xlogx(left) - _xlogx(right + rw) + _xlogx(right)
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            joint[best] += out
            joint[:, best] += into
            joint[best, best] += own
            left[best] += lw
            right[best] += rw
            moved += best != c
            of[w] = best
        if moved <= k // 200:
            break
    return of


@dataclass
class Classes:
    """A class for every word: those of the head words, then those of the places that other words share."""

    head: Lookup
    table: np.ndarray  # [head + 2^tail_log] of uint8
    tail_log: int

    def place(self, h: np.ndarray) -> np.ndarray:
        at = self.head.find(h)
        return np.where(at >= 0, at, len(self.head.names) + (mix(h) >> _U(64 - self.tail_log)).astype(np.int64))

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.table[self.place(h)]


def before(rows: np.ndarray, classes: np.ndarray, start: int) -> np.ndarray:
    """The class of the word before each, start at the beginning of a text.  Words that were never met have none and are passed over."""
    n = len(classes)
    last = np.maximum.accumulate(np.where(classes != NO_CLASS, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    at = np.concatenate([[-1], last[:-1]])[:n]
    first = np.repeat(rows[:-1], np.diff(rows))
    return np.where(at >= first, classes[np.maximum(at, 0)], start).astype(np.int64)


def class_bigrams(texts: DataFrame, classes: Classes, k: int) -> np.ndarray:
    """How often each class follows each, texts' starts as a last row."""
    sent = texts.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        cells = np.zeros((k + 1) * k, np.int64)
        for b in batches:
            for _, rows, h, *_ in hashed_words(b.column(0), lower=True):
                rows, h = with_ends(rows, h)
                c = sent.value.of(h).astype(np.int64)
                cells += np.bincount(before(rows, c, k) * k + c, minlength=len(cells))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    out = np.zeros((k + 1) * k, np.int64)
    for r in texts.transform(mapped, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(k + 1, k)


def likelihood(joint: np.ndarray) -> float:
    """Of class bigrams, up to what classes do not change."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(1)).sum() - _xlogx(joint.sum(0)).sum())


def pulls(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What one occurrence after a class, and one before a class, adds to the likelihood in each class: the derivatives."""
    smooth = joint + ADD
    after = np.log(smooth) - np.log(smooth.sum(1, keepdims=True)) - np.log(smooth.sum(0))
    return after, after[:-1].T


def exchange_places(texts: DataFrame, classes: Classes, k: int, joint: np.ndarray) -> np.ndarray:
    """The table of classes after one round over the corpus: for each place the class of largest gain, by the classes before and after it."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(classes)
    pull = np.vstack(pulls(joint))  # [k + 1 classes before, then k classes after; class]
    width, size = len(pull), len(classes.table)
    bits = max(0, (size - 1).bit_length() - 10)  # buckets of at most 2^10 places, so that a cell (place in its bucket, neighbour) has 16 bits
    buckets = 1 << bits

    def packed(tally):
        """The tallied cells, a row per bucket: what crosses the cluster is arrays, not a row per cell."""
        if not tally.size:
            return
        tally.merge()
        names, counts = tally.names[0], tally.counts[0]
        tally.clear()
        bucket = (names >> _U(16)).astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        edge = np.append(first, len(names))
        cells, counts = (names & _U(0xFFFF)).astype(np.uint16), counts.astype(np.uint32)
        blob = lambda a: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edge * a.itemsize).astype(np.int32)), pa.py_buffer(a)])
        whole = pa.RecordBatch.from_arrays([pa.array(bucket[first]), blob(cells), blob(counts)], names=["bucket", "cells", "counts"])
        for i in range(0, len(first), 2048):
            yield whole.slice(i, 2048)

    def count(batches):
        tally = Tally()
        for b in batches:
            for _, rows, h, *_ in hashed_words(b.column(0), lower=True):
                rows, h = with_ends(rows, h)
                place = sent.value.place(h)
                c = sent.value.table[place].astype(np.int64)
                prev = np.concatenate([[k], c[:-1]])[: len(c)]
                prev[rows[:-1]] = k
                inner = np.ones(len(h), bool)
                inner[rows[1:] - 1] = False  # an end has no word after it
                inner = np.flatnonzero(inner)
                ahead = c[inner + 1]
                cell = ((place & (buckets - 1)) << 16) | ((place >> bits) << 6)
                # a neighbour without a class tells nothing, but that the place is met
                keys = [cell + np.where(prev == NO_CLASS, 63, prev), (cell[inner] + k + 1 + ahead)[ahead != NO_CLASS]]
                if tally.put(*np.unique(np.concatenate(keys).astype(np.uint64), return_counts=True)):
                    yield from packed(tally)
        yield from packed(tally)

    def choose(batches):
        rows = -(-size // buckets)
        bucket, sums = -1, np.zeros(rows * 64)

        def best():
            vectors = sums.reshape(rows, 64)
            met = np.flatnonzero(vectors.any(axis=1))
            at = np.argmax(vectors[met, :width] @ pull, axis=1).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array((met << bits) + bucket), pa.array(at)], names=["place", "class"])

        for b in batches:
            here = b.column(0).to_numpy()
            edge = np.concatenate([np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]])), [len(here)]]) if len(here) else []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if here[i] != bucket:
                    if bucket >= 0:
                        yield best()
                    bucket, sums = int(here[i]), np.zeros(rows * 64)
                cells = np.frombuffer(b"".join(b.column(1)[i:j].to_pylist()), np.uint16)
                sums += np.bincount(cells, np.frombuffer(b"".join(b.column(2)[i:j].to_pylist()), np.uint32), len(sums))
        if bucket >= 0:
            yield best()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.transform(mapped, count, "bucket int, cells binary, counts binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = dealt.transform(mapped, choose, "place long, class int").toArrow()  # a row per place at most
    table = classes.table.copy()
    table[found.column("place").to_numpy()] = found.column("class").to_numpy().astype(np.uint8)
    return table


@dataclass
class BrownModel:
    counts: DataFrame | None  # name, n
    classes: Classes
    transition: np.ndarray  # [class before, class]
    emitted: np.ndarray  # tokens of each class
    total: int
    distinct: int

    def log10(self, context, cls, n):
        p = (1 - MIX) * self.transition[context, cls] * n / np.maximum(self.emitted[cls], 1)
        return np.log10(p + MIX * (n + 1) / (self.total + self.distinct + 1))


def fit(docs: DataFrame, id_col="doc_id", text_col="text", classes: int = CLASSES, core_words: int = CORE, head_words: int = HEAD, tail_log: int = TAIL_LOG, rounds: int = CORPUS_ROUNDS) -> BrownModel:
    """classes: at most 31; core_words: at most head_words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where(training(id_col)).select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    counts = settle(count_words(texts), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.col("n").desc(), "name").limit(head_words).toArrow()
    names, n = top.column("name").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(names)
    head = Lookup(names[order], n[order])
    core = np.sort(order.argsort()[:core_words])  # places in the head of the most frequent words
    table = np.full(len(names) + (1 << tail_log), NO_CLASS, np.uint8)
    if len(names):
        bigrams = core_bigrams(texts, head.names[core])
        of = exchange(bigrams, head.counts[core], classes)
        onehot = np.eye(classes)[of]
        joint = np.vstack([onehot.T @ bigrams[:-1], bigrams[-1:]]) @ onehot
        table[core] = of
        table = exchange_places(texts, Classes(head, table, tail_log), classes, joint)
        table[core] = of
    known = Classes(head, table, tail_log)
    joint = class_bigrams(texts, known, classes)
    for _ in range(rounds if len(names) else 0):
        moved = Classes(head, exchange_places(texts, known, classes, joint), tail_log)
        grown = class_bigrams(texts, moved, classes)
        if likelihood(grown) <= likelihood(joint):
            break
        known, joint = moved, grown
    emitted = joint.sum(0)
    transition = joint + ADD * (emitted > 0)
    transition = transition / np.maximum(transition.sum(1, keepdims=True), 1e-300)
    return BrownModel(counts, known, transition, emitted, int(total), int(distinct))


def score(docs: DataFrame, model: BrownModel, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id, n_tokens, n_known, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    classes = model.transition.shape[1]
    light = BrownModel(None, model.classes, model.transition, model.emitted, model.total, model.distinct)
    sent = spark.sparkContext.broadcast(light)  # bounded by the head, the places and the classes
    kind = docs.schema[id_col].dataType
    names = ["key", "id", "name", "weight", "times", "copies", "n_tokens", "n_known", "base", "score"]
    schema = f"key long, id {kind.simpleString()}, name long, weight double, times int, copies int, n_tokens long, n_known long, base double, score double"

    def run(batches):
        m = sent.value
        smooth = m.total + m.distinct + 1
        for b in batches:
            keys = b.column(0).to_numpy()
            for i, rows, h, *_ in hashed_words(b.column(2), lower=True):
                rows, h = with_ends(rows, h)
                k = len(rows) - 1
                text = np.repeat(np.arange(k), np.diff(rows))
                place = m.classes.place(h)
                own_class = m.classes.table[place]
                ctx = before(rows, own_class, classes)
                in_head = place < len(m.classes.head.names)
                hit = np.flatnonzero(in_head)
                n = m.classes.head.counts[place[hit]]
                sums = lambda w: np.bincount(text[hit], w, k)  # noqa: B023,E731
                base, lp = sums(np.log10((n + 1) / smooth)), sums(m.log10(ctx[hit], own_class[hit], n))
                own = keys[i : i + k]
                yield pa.RecordBatch.from_arrays([pa.array(own), b.column(1)[i : i + k], pa.array(~own), pa.array(np.zeros(k)), pa.array(np.zeros(k, np.int32)), pa.array(np.ones(k, np.int32)), pa.array(np.diff(rows)), pa.array(np.bincount(text[hit], minlength=k)), pa.array(base, pa.float64()), pa.array(lp, pa.float64())], names=names)
                rest = np.flatnonzero(~in_head)
                order = rest[np.lexsort((h[rest], ctx[rest], text[rest]))]
                if len(order):
                    t, c, w = text[order], ctx[order], h[order]
                    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1])]))
                    r, zero = len(first), np.zeros(len(first))
                    cls = own_class[order[first]]
                    seen = cls != NO_CLASS  # others have no count either
                    cls = np.where(seen, cls, 0)
                    weight = seen * (1 - MIX) * m.transition[c[first], cls] / np.maximum(m.emitted[cls], 1)
                    times = np.diff(np.append(first, len(order)))
                    yield pa.RecordBatch.from_arrays([pa.array(own[t[first]]), pa.nulls(r, b.column(1).type), pa.array(w[first].view(np.int64)), pa.array(weight), pa.array(times.astype(np.int32)), pa.array(zero.astype(np.int32)), pa.array(zero.astype(np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], names=names)

    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("t")).transform(mapped, run, schema)
    full = rows.join(model.counts, "name", "left")
    smooth = float(model.total + model.distinct + 1)
    n = F.coalesce("n", F.lit(0))
    p = F.col("weight") * n + F.lit(MIX) * (n + 1) / smooth
    times = F.col("times")
    sums = full.groupBy("key").agg(
        F.max("id").alias("id"),
        F.sum("copies").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("n").isNotNull(), times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(times > 0, times * F.log10((n + 1) / smooth)).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(times > 0, times * F.log10(p)).otherwise(0.0)).alias("score"),
    )
    each = lambda c: (F.col(c) / F.col("copies")).alias(c)
    one = sums.select(F.col("id").alias(id_col), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"), each("n_tokens"), each("n_known"), each("base"), each("score"))
    return one.select(id_col, F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.col("base").alias("base_score"), "score")


def op1_brown_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs)
    return score(docs, model).select("doc_id", (~training()).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")

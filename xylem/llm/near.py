"""Near-duplicate documents by Order MinHash.

A text's runs of five words (a shorter text: all its words) are labelled by their occurrence, so that each labelled run is unique in its
text.  A sketch takes, under one of BANDS hash functions, the LEAST runs of least hash and keeps them in text order; texts of
edit similarity share such ordered samples.  Texts that share one of their sketches are candidates; a banded
alignment of their labelled runs then decides: with L runs aligned in order, likeness = 2 L / (n + m) >= 0.8.  A pair that can reach
it never aligns runs further apart than the band, so the band loses nothing.

So whatever has a Jaccard likeness of 0.8 in order is linked, and so are copies down to 0.67 (likeness 0.8).  With 24 sketches of 3
runs a pair at that edge is missed with probability (1 - 0.67^3)^24 = 2e-4, one of Jaccard 0.8 with 3e-8.

Groups.  Equal texts are one node from the start.  Nodes that share a sketch form a bucket.  A bucket's pivot is its node that meets most
others over all buckets, of near copies so the original.  Round 1 verifies each node with its most met pivot.  Round 2 verifies it with the
pivot and with its neighbour in each bucket, where these are still apart.  Round 3 takes the buckets that still hold several groups
and looks for links of nodes outside the bucket's largest group.  Among these nodes a run is hot if more than HOT texts have it,
else cold.  Texts that share a cold run meet by it, HOT partners a run at most.  Texts that share none can only be linked by hot runs: these are
counted for each text in SLOTS slots by their hash, and a pair is compared if the sum over the slots of the lesser counts reaches
what a link needs, and for the others the cold runs they share are added to that sum.  These are upper bounds of what can be
aligned, so no link that a bucket shows is lost, and copies of one text that are too far from each other are not compared.
Rounds 2 and 3 end in connected components: each task joins the links it reads, then large-star and small-star until every node has one root.

Nulls: a null text is empty; empty texts are equal.  A null id sorts last.  Repeated rows are equal texts.  Texts equal but for white
space have likeness 1.  An empty table gives an empty one.  Other columns are kept by `keep_one` and not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _U, blocks, cut_words, hash_spans, hashed_words, mapped, mix, settle, small_batches, text_bytes

WIDTH, BANDS, LEAST, LIKENESS = 5, 24, 3, 0.8
HOT, SLOTS = 64, 16
_ODD = mix(np.arange(101, 101 + BANDS, dtype=np.uint64)) | _U(1)
_SALT = mix(np.arange(301, 301 + BANDS, dtype=np.uint64))
_M = _U(0x9FB21C651E98DF25)


def runs_of(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Names of the runs of words of one text, labelled by occurrence, in text order."""
    n = max(len(words) - width + 1, 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        h = mix(h * _M + words[k : k + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    if len(same):
        new = np.concatenate([[True], s[1:] != s[:-1]])
        start = np.flatnonzero(new)
        nth = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        label = np.empty(n, np.uint64)
        label[order] = nth.astype(np.uint64)
        h = np.where(label > 0, mix(h + label * _M), h)
    return h


def sketches(runs: np.ndarray, bands: int = BANDS, least: int = LEAST) -> np.ndarray:
    """For each band a name of the least runs in text order."""
    n = len(runs)
    if n <= least:
        picked = np.broadcast_to(runs, (bands, n))
    elif n > 1 << 15:
        picked = np.stack([runs[np.sort(np.argpartition(runs * a, least)[:least])] for a in _ODD[:bands]])
    else:
        at = np.sort(np.argpartition(runs[None, :] * _ODD[:bands, None], least, axis=1)[:, :least], axis=1)
        picked = runs[at]
    out = _SALT[:bands].copy()
    for k in range(picked.shape[1]):
        out = mix(out * _M + picked[:, k])
    return out


def alignment_likeness(a: np.ndarray, b: np.ndarray, wanted: float = LIKENESS) -> float:
    """2 L / (n + m) with L the longest common subsequence within the band; 0 where it cannot reach `wanted`."""
    n, m = len(a), len(b)
    need = int(np.ceil(wanted * (n + m) / 2 - 1e-9))
    if min(n, m) < need:
        return 0.0
    band = max(n, m) - need
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), m - 1)
    j = order[at]
    i = np.flatnonzero((b[j] == a) & (np.abs(j - np.arange(n)) <= band))
    if len(i) < need:
        return 0.0
    j = j[i]
    if not (j[1:] > j[:-1]).all():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        found = len(tails)
    else:
        found = len(j)
    return 2 * found / (n + m)


def sketch_rows(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id, node, n, sketches); node names the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches):
        for b in batches:
            for i, rows, h, *_ in hashed_words(b.column(2)):
                k = len(rows) - 1
                n, out = np.empty(k, np.int64), np.empty((k, BANDS), np.uint64)
                for r in range(k):
                    runs = runs_of(h[rows[r] : rows[r + 1]])
                    n[r], out[r] = len(runs), sketches(runs)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * BANDS), pa.array(out.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + k], b.column(1)[i : i + k], pa.array(n), listed], names=["id", "node", "n", "sketches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.xxhash64(text, F.length(text)), text).transform(mapped, run, f"id {kind}, node long, n long, sketches array<long>")


def _texts(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """One row (node, text) for each of the nodes.  A Bloom filter of fixed size leaves most other texts where they are; the join decides."""
    from .privacy import build_bloom

    sent = docs.sparkSession.sparkContext.broadcast(build_bloom(nodes))

    def run(batches):
        for b in batches:
            hit = pa.array(sent.value.test(b.column(0).to_numpy()))
            yield b.filter(hit)

    text = F.coalesce(F.col(text_col), F.lit(""))
    near = docs.select(F.xxhash64(text, F.length(text)).alias("node"), text.alias("text")).transform(mapped, run, "node long, text string")
    return near.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def verify(pairs: DataFrame, texts: DataFrame, wanted: float = LIKENESS) -> DataFrame:
    """The pairs (a, b) whose texts are alike."""
    def words(column):
        data, off = text_bytes(column)
        for i, j in blocks(off):
            part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            starts, ends, rows = cut_words(part, at)
            h = hash_spans(part, starts, ends)
            for r in range(j - i):
                yield h[rows[r] : rows[r + 1]]

    def run(batches):
        last, runs_b = None, None
        for batch in batches:
            bs = batch.column(1).to_pylist()
            good = []
            for b, wa, wb in zip(bs, words(batch.column(2)), words(batch.column(3)), strict=True):
                if b != last:
                    last, runs_b = b, runs_of(wb)
                good.append(alignment_likeness(runs_of(wa), runs_b, wanted) >= wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("_ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("_tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb").transform(mapped, run, "a long, b long")


def _union_find(batches, most: int = 1 << 20):
    """Rows (node, root) of the links read, which are given out and forgotten beyond `most` nodes."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def rows():
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > most:
            yield rows()
            parent.clear()
    yield rows()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """Rows (node, root) of the linked nodes; root is the least node of the component.  Raises if `most` rounds are not enough.  links: a table
    that is cheap to read; each task forgets what it reads twice, so repeated links need no shuffle of their own."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    for _ in range(most):
        local = settle(edges.transform(mapped, _union_find, "node long, root long"), "components")
        per = settle(local.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")), "components")
        if per.where("root <> other").isEmpty():
            return per.select("node", "root")
        edges = local.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components are not complete after {most} rounds")


def _grouped(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Adds the group of each node: its component's root, or itself."""
    if parts is None:
        return rows.withColumn("group", F.col("node"))
    return rows.join(parts, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")


def run_evidence(texts: DataFrame, nodes: DataFrame, hot: int = HOT, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """nodes (node, group, rest).  Two tables: (a, b, shared), for nodes of different groups, one of them rest, how many cold runs
    they share, at least one; (node, hot), the number of a node's hot runs in each slot."""
    def list_runs(batches):
        for b in batches:
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3)]
            for i, rows, h, *_ in hashed_words(b.column(1)):
                runs = [runs_of(h[rows[r] : rows[r + 1]]) for r in range(len(rows) - 1)]
                sizes = np.array([len(r) for r in runs])
                each = [pa.array(np.repeat(c[i : i + len(runs)], sizes)) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(runs).view(np.int64)), *each], names=["run", "node", "group", "rest"])

    def counted(a, b, slot):
        order = np.lexsort((slot, b, a))
        a, b, slot = a[order], b[order], slot[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (slot[1:] != slot[:-1])]))
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(slot[first].astype(np.int32)), pa.array(np.diff(np.append(first, len(a))))], names=["a", "b", "slot", "n"])

    def tell(run, node, group, rest, is_hot):
        if is_hot.any():
            yield counted(node[is_hot], node[is_hot], (run[is_hot].view(np.uint64) >> _U(7)).astype(np.int64) % slots)
        run, node, group, rest = (c[~is_hot] for c in (run, node, group, rest))
        for k in range(1, hot):
            same = run[k:] == run[:-k]
            if not same.any():
                break
            i = np.flatnonzero(same & (group[k:] != group[:-k]) & (rest[k:] | rest[:-k]))
            if len(i):
                yield counted(np.minimum(node[i], node[i + k]), np.maximum(node[i], node[i + k]), np.full(len(i), -1))

    def judge(batches):
        """Sorted by run.  The rows of the last run wait for the next batch, `hot` of them at most: what has more is hot."""
        held, known_hot = None, None
        for b in batches:
            part = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            run = part[0]
            if not len(run):
                continue
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            sizes = np.diff(np.append(first, len(run)))
            big = sizes > hot
            if known_hot is not None:
                big[0] |= run[0] == known_hot
            cut = len(run) if big[-1] else first[-1]
            known_hot = run[-1] if big[-1] else None
            if cut:
                yield from tell(*[c[:cut] for c in part], np.repeat(big, sizes)[:cut])
            held = [c[cut:] for c in part]
        if held is not None and len(held[0]):
            yield from tell(*held, np.zeros(len(held[0]), bool))

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = texts.join(nodes, "node").select("node", "text", "group", "rest").transform(mapped, list_runs, "run long, node long, group long, rest boolean")
    found = settle(runs.repartition(parts, "run").sortWithinPartitions("run").transform(mapped, judge, "a long, b long, slot int, n long"), "run-evidence")
    cold = found.where("slot < 0").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    hot_counts = found.where("slot >= 0").groupBy(F.col("a").alias("node")).agg(F.array(*[F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)) for k in range(slots)]).alias("hot"))
    return cold, hot_counts


def _lesser(one: str, two: str, slots: int = SLOTS):
    """The sum over the slots of the lesser counts."""
    return sum((F.least(F.get(one, k), F.get(two, k)) for k in range(slots)), F.lit(0))


def open_pairs(texts: DataFrame, open_rows: DataFrame, wanted: float = LIKENESS) -> DataFrame:
    """Pairs (a, b) that buckets show and bounds leave open.  open_rows (bucket, node, n, group, main) of buckets with several groups."""
    nodes = open_rows.groupBy("node").agg(F.first("n").alias("n"), F.first("group").alias("group"), F.max(F.col("group") != F.col("main")).alias("rest"))
    nodes = settle(nodes, "open-nodes")
    cold, hot = run_evidence(texts, nodes.select("node", "group", "rest"))
    none = F.array(*[F.lit(0).cast("long")] * SLOTS)
    info = settle(nodes.join(hot, "node", "left").select("node", "n", F.coalesce("hot", none).alias("hot")), "open-nodes")
    of = lambda c: info.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("hot").alias(f"hot_{c}"))
    need = wanted / 2 * (F.col("n_a") + F.col("n_b")) - 1e-6
    met = cold.join(of("a"), "a").join(of("b"), "b").where(F.col("shared") + _lesser("hot_a", "hot_b") >= need).select("a", "b")
    total = sum((F.get("hot", k) for k in range(SLOTS)), F.lit(0))
    rows = open_rows.drop("n").join(info, "node").withColumn("_total", total)
    least = rows.groupBy("bucket").agg(F.min("n").alias("_least"))
    rows = rows.join(least, "bucket").where(F.col("_total") >= wanted / 2 * (F.col("n") + F.col("_least")) - 1e-6)
    one = rows.where(F.col("group") != F.col("main")).select("bucket", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("hot").alias("hot_a"), F.col("group").alias("g_a"))
    two = rows.select("bucket", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("hot").alias("hot_b"), F.col("group").alias("g_b"), (F.col("group") == F.col("main")).alias("in_main"))
    apart = (F.col("g_a") != F.col("g_b")) & (F.col("in_main") | (F.col("a") < F.col("b")))
    by_hot = one.join(two, "bucket").where(apart & (_lesser("hot_a", "hot_b") >= need)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.unionByName(by_hot).distinct()


def link_groups(docs: DataFrame, id_col="doc_id", text_col="text", wanted: float = LIKENESS) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (id, node) of all documents; nodes (node, group) of all texts."""
    small_batches(docs.sparkSession)
    scanned = settle(sketch_rows(docs, id_col, text_col), "sketches")
    nodes = settle(scanned.groupBy("node").agg(F.first("n").alias("n"), F.first("sketches").alias("sketches")), "nodes")
    held = nodes.select("node", "n", F.explode("sketches").alias("bucket"))
    shared = settle(held.join(held.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket"), "buckets")
    texts = settle(_texts(docs, shared.select("node").distinct(), text_col), "candidate-texts")
    # a group of near copies has its original, or the copy next to it, in most of its buckets
    fame = shared.groupBy("node").agg(F.sum("size").alias("fame"))
    famed = shared.join(fame, "node")
    pivots = famed.groupBy("bucket").agg(F.max(F.struct("fame", "node")).alias("pivot"))
    shared = settle(famed.join(pivots, "bucket").select("bucket", "node", "n", "size", "pivot"), "buckets")
    # round 1: one partner for each node
    others = shared.where(F.col("node") != F.col("pivot.node"))
    first = others.groupBy("node").agg(F.max("pivot").alias("b")).select(F.col("node").alias("a"), F.col("b.node").alias("b"))
    links = settle(verify(first, texts, wanted), "links")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    # round 2: the first and the next node of each bucket, where still apart
    order = Window.partitionBy("bucket", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / 1000))).orderBy("node")
    beside = shared.where("size > 2").select("node", F.lag("node").over(order).alias("other")).where("other IS NOT NULL")
    second = others.select("node", F.col("pivot.node").alias("other")).unionByName(beside).distinct()
    second = _apart(second, stars).join(first, ["a", "b"], "left_anti")
    links = links.unionByName(settle(verify(second, texts, wanted), "links"))
    parts = components(links)
    # round 3: what is still apart in a bucket
    known = _grouped(shared.where("size > 2").select("bucket", "node", "n"), parts)
    per = known.groupBy("bucket", "group").agg(F.count("*").alias("k"))
    top = per.groupBy("bucket").agg(F.max_by("group", F.struct("k", "group")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    open_rows = settle(known.join(top.select("bucket", "main"), "bucket"), "open-buckets")
    if not open_rows.isEmpty():
        known = parts.select(F.col("node").alias("a"), F.col("root").alias("b"))
        parts = components(known.unionByName(settle(verify(open_pairs(texts, open_rows, wanted), texts, wanted), "links")))
    return scanned.select("id", "node"), _grouped(nodes.select("node"), parts)


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    one = parts.select("node", F.col("root").alias("_ra"))
    two = parts.select(F.col("node").alias("other"), F.col("root").alias("_rb"))
    joined = pairs.join(one, "node", "left").join(two, "other", "left")
    return joined.where(F.coalesce("_ra", "node") != F.coalesce("_rb", "other")).select(F.col("node").alias("a"), F.col("other").alias("b"))


def classes(docs: DataFrame, id_col="doc_id", text_col="text", wanted: float = LIKENESS) -> DataFrame:
    """Rows (id, class_id, class_size) for each row of docs: class_id is the least id of its class."""
    rows, groups = link_groups(docs, id_col, text_col, wanted)
    placed = settle(rows.join(groups, "node"), "classes")
    of = placed.groupBy("group").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(of, "group").select(F.col("id").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", wanted: float = LIKENESS) -> DataFrame:
    """One row of each class, with all its columns: that of least id; of equal rows one.  Rows are dealt by text and id, so that copies
    spread and only those of one id meet."""
    rows, groups = link_groups(docs, id_col, text_col, wanted)
    best = rows.join(groups, "node").groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best"))
    best = settle(best.select(F.col("best.node").alias("_node"), F.col("best.id").alias("_best")), "kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    text = F.coalesce(text_at, F.lit(""))
    kept = docs.toDF(*names).withColumn("_node", F.xxhash64(text, F.length(text)))
    kept = kept.join(best, (kept["_node"] == best["_node"]) & id_at.eqNullSafe(best["_best"]), "left_semi")
    again = rows.groupBy("node", "id").count().where("count > 1").join(best, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_best")), "left_semi")
    if not again.isEmpty():  # a kept row stands several times
        kept = kept.dropDuplicates(["_node"])
    return kept.select(*names).toDF(*docs.columns)


def op9_order_minhash(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage_near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs)

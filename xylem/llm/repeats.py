"""Substring deduplication by recompression.

A text's words are symbols; rounds name runs and pairs of symbols, the same everywhere, as a name is a hash of what it
stands for.  Round 1 names runs of two equal words; each round then splits the symbols by a bit of their hash into left and right
ones and names every pair (left, right).  A symbol may stand for 2, 3, 4 and 5 words after rounds 1, 2, 3 and 4.

Equal passages get equal symbols but at their edges.  Of 50 words, at either edge at most 2 + 1 words depend on what stands beside them
after round 1 (a run cut by the edge, a pair over it), 2 more after round 2, then 3, then 4: the CORE of 26 words agrees.  It holds at
least 6 whole symbols of at most 5 words, so 5 pairs of neighbouring symbols.  Of any 4 such neighbours the one of least hash is an
anchor.  So windows of 50 equal words share an anchor at the same place, and more: every 4 neighbours that lie in the core of a
repeated window have an anchor that several documents hold.

Plan: 1. a task lists its documents' anchors; anchors of several documents are found by a shuffle on the anchor.  2. They go back to
their documents (a join by key); only windows that can repeat by what was said are named, by a hash of their 50 words.  3. A
shuffle on the window's name tells which also start in a document of smaller id.  4. These go back, and the words under them are
removed.  In 1 and 3 a task first settles what repeats within a batch, so that a passage of very many documents sends a row per batch, not
per document.

Nulls: a null text has no words; rows with null id keep all words, and none is removed for them.  Rows of equal id are one document as
to whose window is first (equal ids do not remove each other's words), each with its own result.  Windows inside one document
do not count against it.  An empty table gives an empty one.  Other columns are not read.  Names are 64-bit hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, hashed_words, mapped, mix, row_key, small_batches

WINDOW = 50
CAPS = (2, 3, 4, 5)
NEAR = 4  # neighbouring pairs of symbols, of which the least is an anchor
EDGE = 12  # words at either edge of a window that may depend on its surroundings
_R = 0xD6E8FEB86659FD93
_BASE = mix(np.arange(1, 17, dtype=np.uint64))


def _merge(sym, size, doc, at, join, new):
    """Joins each marked symbol with the one after it."""
    keep = np.ones(len(sym), bool)
    keep[np.flatnonzero(join) + 1] = False
    sym, size = sym.copy(), size.copy()
    where = np.flatnonzero(join)
    sym[where] = new
    size[where] += size[where + 1]
    return sym[keep], size[keep], doc[keep], at[keep]


def symbols(words: np.ndarray, doc: np.ndarray):
    """Names, sizes, documents and first words of the symbols of the last round."""
    sym, size, at = words, np.ones(len(words), np.int64), np.arange(len(words))
    for k, cap in enumerate(CAPS):
        if len(sym) < 2:
            break
        same = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1])
        if k == 0:
            run = np.zeros(len(sym), bool)
            run[:-1] = same
            run[1:] &= ~same
            run[:-2] &= ~same[1:]
            where = np.flatnonzero(run)
            sym, size, doc, at = _merge(sym, size, doc, at, run, mix(sym[where] ^ _BASE[8]))
            if len(sym) < 2:
                break
        right = (mix(sym ^ _BASE[k]) >> _U(63)).astype(bool)
        join = np.zeros(len(sym), bool)
        join[:-1] = ~right[:-1] & right[1:] & (doc[1:] == doc[:-1]) & (size[1:] + size[:-1] <= cap)
        where = np.flatnonzero(join)
        sym, size, doc, at = _merge(sym, size, doc, at, join, mix(sym[where] * _U(_R) + sym[where + 1] + _BASE[9]))
    return sym, size, doc, at


def anchors(words: np.ndarray, doc: np.ndarray):
    """Of each NEAR neighbouring pairs of symbols (all there are, where a document has fewer): the least hash, the document, the place and
    end of that pair, the first word and the end of all, and whether they are NEAR."""
    sym, size, doc, at = symbols(words, doc)
    i = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    g, d, begin, end = mix(sym[i] * _U(_R) + mix(sym[i + 1])), doc[i], at[i], at[i + 1] + size[i + 1]
    n = len(g)
    least, place, last = g.copy(), np.arange(n), np.arange(n)
    for k in range(1, NEAR):
        if n > k:
            here = np.flatnonzero(d[k:] == d[:-k])
            better = here[g[here + k] < least[here]]
            least[better], place[better] = g[better + k], better + k
            last[here] = here + k
    full = last == np.arange(n) + NEAR - 1
    keep = full | ~np.concatenate([[False], d[1:] == d[:-1]]) if n else full  # a document's last pairs are in full ones already
    s = np.flatnonzero(keep)
    return least[s], d[s], begin[place[s]], end[place[s]], begin[s], end[last[s]], full[s]


def window_names(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    up = np.full(len(words) + 1, _R | 1, np.uint64)
    up[0] = 1
    up = np.cumprod(up)
    down = np.full(len(words) + 1, pow(_R | 1, -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.cumprod(down)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * up[:-1], out=total[1:])
    return mix((total[starts + WINDOW] - total[starts]) * down[starts])


def _block(rows: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def _first_of_equal(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


_ROW = "name long, id long, tag long, state int"  # state: 0 open, 1 known to be in several documents, 2 settled
_NAMES = ["name", "id", "tag", "state"]


def _rows(name, doc, tag, state):
    return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(state.astype(np.int32))], names=_NAMES)


def list_anchors(docs: DataFrame) -> DataFrame:
    """docs (id, tag, text): rows (anchor, id, tag, state), each anchor once for each document."""
    def run(batches):
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            found = [[], [], []]
            for i, rows, h, *_ in hashed_words(b.column(2)):
                g, d, *_ = anchors(h, _block(rows))
                long = np.diff(rows)[d] >= WINDOW
                for f, v in zip(found, (g[long], ids[i + d[long]], tags[i + d[long]]), strict=True):
                    f.append(v)
            if not found[0]:
                continue
            g, doc, tag = map(np.concatenate, found)
            order = np.lexsort((tag, doc, g))
            g, doc, tag = g[order], doc[order], tag[order]
            one = _first_of_equal(g, doc, tag)
            g, doc, tag = g[one], doc[one], tag[one]
            if not len(g):
                continue
            new = _first_of_equal(g)
            group = np.cumsum(new) - 1
            several = (np.maximum.reduceat(doc, np.flatnonzero(new)) > np.minimum.reduceat(doc, np.flatnonzero(new)))[group]
            yield _rows(g, doc, tag, np.where(several, np.where(new, 1, 2), 0))

    return docs.transform(mapped, run, _ROW)


def _grouped(rows: DataFrame, judge, schema: str) -> DataFrame:
    """Deals rows by name (settled ones by document), sorts by name and id, and gives whole groups to judge, batch by batch."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, F.when(F.col("state") == 2, F.xxhash64("id", "tag")).otherwise(F.col("name"))).sortWithinPartitions("name", "id")

    def run(batches):
        held = None
        for b in batches:
            part = [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            name = part[0]
            cut = int(np.searchsorted(name, name[-1])) if len(name) else 0
            if cut:
                yield from judge(*[x[:cut] for x in part])
            held = [x[cut:] for x in part]
        if held is not None and len(held[0]):
            yield from judge(*held)

    return dealt.transform(mapped, run, schema)


def _shared(name, doc, tag, state):
    first = np.flatnonzero(_first_of_equal(name))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(name))))
    yes = (np.maximum.reduceat(state, first) > 0) | (np.maximum.reduceat(doc, first) > np.minimum.reduceat(doc, first))
    at = np.flatnonzero(yes[group])
    for i in range(0, len(at), 1 << 16):
        k = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(tag[k]), pa.array(name[k])], names=["id", "tag", "anchor"])


def _later(name, doc, tag, state):
    first = np.flatnonzero(_first_of_equal(name))
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(name))))
    at = np.flatnonzero((doc > least) | (state == 2))
    for i in range(0, len(at), 1 << 16):
        k = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array((tag[k] >> 32).astype(np.int64)), pa.array((tag[k] & 0xFFFFFFFF).astype(np.int64))], names=["id", "tag", "start"])


def name_windows(docs: DataFrame) -> DataFrame:
    """docs (id, tag, text, anchors): rows (window, id, tag << 32 | start, state) of the windows around shared anchors."""
    def run(batches):
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            listed = b.column(3)
            flat, off = listed.values.to_numpy().view(np.uint64), listed.offsets.to_numpy()
            found = [[], [], []]
            for i, rows, h, *_ in hashed_words(b.column(2)):
                block = _block(rows)
                g, d, begin, end, first, stop, full = anchors(h, block)
                k = len(rows) - 1
                wanted = flat[off[i] : off[i + k]]
                owner = np.repeat(np.arange(k), np.diff(off[i : i + k + 1]))
                hit = np.isin(mix(g) + d.astype(np.uint64), mix(wanted) + owner.astype(np.uint64))
                # windows around a shared anchor, but for those that hold an anchor of one document in their core
                step, bar = np.zeros(len(h) + 1, np.int64), np.zeros(len(h) + 1, np.int64)
                for count, lo, hi, which in ((step, end - WINDOW, begin, hit), (bar, stop - WINDOW + EDGE, first - EDGE, full & ~hit)):
                    lo, hi = np.maximum(lo, rows[d])[which], np.minimum(hi, rows[d + 1] - WINDOW)[which]
                    ok = hi >= lo
                    np.add.at(count, lo[ok], 1)
                    np.add.at(count, hi[ok] + 1, -1)
                starts = np.flatnonzero((np.cumsum(step) > 0)[:-1] & (np.cumsum(bar) == 0)[:-1])
                if len(starts):
                    d = block[starts]
                    for f, v in zip(found, (window_names(h, starts), ids[i + d], (tags[i + d] << 32) | (starts - rows[d])), strict=True):
                        f.append(v)
            if not found[0]:
                continue
            w, doc, place = map(np.concatenate, found)
            order = np.lexsort((place, doc, w))
            w, doc, place = w[order], doc[order], place[order]
            new = _first_of_equal(w)
            first = np.flatnonzero(new)
            least = np.repeat(doc[first], np.diff(np.append(first, len(w))))
            settled = doc > least
            # of the least document one row tells the others; repeats inside it stay open, as they need the answer too
            yield _rows(np.where(settled, _U(0), w), doc, place, np.where(settled, 2, 0))

    return docs.transform(mapped, run, _ROW)


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id, n_words, n_removed, kept) for each row of docs; kept are the words that stay, joined by blanks."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # no key is null (a null id is 0 with a tag of its own), so that both joins below read one and the same exchange of the texts
    none = F.col(id_col).isNull()
    tag = row_key(id_col, text_col).bitwiseAND(F.lit((1 << 31) - 1)) + F.when(none, F.lit(1 << 31)).otherwise(0)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), tag.alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = _grouped(list_anchors(base.where(F.col("tag") < 1 << 31)), _shared, "id long, tag long, anchor long")
    listed = shared.groupBy("id", "tag").agg(F.collect_set("anchor").alias("anchors"))
    dealt = base.repartition(parts, "id", "tag")
    around = dealt.join(listed, ["id", "tag"]).select("id", "tag", "text", "anchors")
    later = _grouped(name_windows(around), _later, "id long, tag long, start long")
    starts = later.groupBy("id", "tag").agg(F.collect_set("start").alias("starts"))

    def run(batches):
        for b in batches:
            listed = b.column(2)
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(b.column(1).to_pylist(), listed, strict=True):
                words = text.encode("utf-8").split()
                n_words.append(len(words))
                gone = 0
                if starts.is_valid:
                    s = starts.values.to_numpy()
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, s, 1)
                    np.add.at(step, s + WINDOW, -1)
                    stay = np.cumsum(step)[:-1] == 0
                    gone = len(words) - int(stay.sum())
                    words = list(compress(words, stay.tolist()))
                n_removed.append(gone)
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    whole = dealt.join(starts, ["id", "tag"], "left").select(F.when(F.col("tag") < 1 << 31, F.col("id")).alias("id"), "text", "starts")
    return whole.transform(mapped, run, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def op4_recompression(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# Every window of 50 words by its text, the least document of each, and the words under windows of later documents.
OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: length(x) > 0) AS ws FROM t),
 s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
 n AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM s),
 f AS (SELECT h, min(doc_id) AS least FROM n GROUP BY h),
 r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM n JOIN f USING (h) WHERE doc_id > least),
 g AS (SELECT doc_id, list(pos) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
 sha256(array_to_string(list_filter(ws, lambda x, k: gone IS NULL OR NOT list_contains(gone, k)), ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

"""One very large document: a splittable scan whose chunks are read by arrays, each from the state in which it begins.

Rows end at a `<`, so a split never cuts a tag; a chunk is some MB of rows of one file block, and its records, what stands between two `<`,
hold one tag and the text after it each.  A first scan gives for each chunk what it changes: bytes, CDATA, depth, the elements left open, and the siblings that
other chunks count on.  The driver folds these, a small row per chunk, into the state at the beginning of each chunk, and a last scan gives
the hits; no text is shuffled.  What crosses chunks otherwise (children that a step asks for, CDATA after a tag) is met by a scan of its own.

A document may also be kept in parts, as tasks write it: files of one folder, each of which begins at a `<`.  The fold goes on from part to part.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ATTRIBUTE, CDATA_OPEN, START_TAG, comparison, from_bytes, unwrap
from ..plans.xpath_ast import Attribute, Child, Index, Last, Position, Step, parse_xpath
from ..plans.xpath_plan import OPS, child_condition
from .documents import shared_path

CHUNK = 4 << 20
#: Rows may end at any text that ends with `<`.  The first by which no row of any file is longer than LONGEST is taken; the last takes rows of any length.
ENDS, LONGEST = ("\n<", "><", "<"), 1 << 16
_PACKED = re.compile(r"\.(gz|bz2|deflate|lz4|snappy|zst)$")
_START, _ATTRIBUTE = re.compile(START_TAG.encode()), re.compile(ATTRIBUTE.encode())
_SECTION = re.compile(rb"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", re.S)
_ATTRIBUTE_NAME = re.compile(rb"[\w.:-]+")
_NAME_ENDS, _BLANKS, _NAMES = np.zeros((3, 256), bool)
_NAME_ENDS[list(b" \t\n\x0b\f\r/>")] = True
_BLANKS[list(b" \t\n\x0b\f\r")] = True
_NAMES[[c for c in range(256) if _ATTRIBUTE_NAME.fullmatch(bytes([c]))]] = True


def records(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Rows (file, block, value) of the bytes of the files, each with its end; file is a 64-bit name of the file's path.  Rows over LONGEST are
    left out unless the end is the last of ENDS."""
    reader = spark.read.option("lineSep", end)
    reader = reader if end == ENDS[-1] else reader.option("mapreduce.input.linerecordreader.line.maxlength", str(LONGEST))
    return reader.text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit(end)).alias("value"))


def _chunks(batches, most: int):
    """Yields (key, data): the bytes of each chunk; key is (file, block, number).  Where chunks end depends on the bytes only."""
    key, held, place = None, [], 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        value = batch.column(2).cast(pa.large_binary())
        off = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + n + 1]
        data = np.frombuffer(value.buffers()[2] or b"", np.uint8)
        edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1), n]
        for a, b in zip(edges, edges[1:], strict=False):
            where = (int(file[a]), int(block[a]))
            if key is None or key[:2] != where:
                if held:
                    yield key, np.concatenate(held)
                key, held, place = (*where, 0), [], 0
            number = (place + off[a:b] - off[a]) // most
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), b - a]
            for c, d in zip(cuts, cuts[1:], strict=False):
                if held and number[c] != key[2]:
                    yield key, np.concatenate(held)
                    held = []
                key = (*where, int(number[c]))
                held.append(data[off[a + c] : off[a + d]])
            place += int(off[b] - off[a])
    if held:
        yield key, np.concatenate(held)


class _Tags:
    """The records of a chunk.  start: bytes of the chunk before the record; sign: 1 open, -1 close, 0 empty; mark: 0 where a record
    with `]]>` ends outside CDATA, 1 where one that opens a section ends inside, -1 where nothing changes."""

    def __init__(self, key: tuple[int, int, int], data: np.ndarray, room: int, most: int | None = None):
        """most: bytes from here to the end of the file, if they are known; what was put after them is left out."""
        self.size = len(data)
        ends = np.flatnonzero((data == ord("<")) | (data == ord(">")))
        gt = data[ends] == ord(">")
        lt = np.flatnonzero(~gt)
        end, following = ends[lt], np.concatenate([[0], lt[:-1] + 1])
        start = np.concatenate([[0], end[:-1] + 1])
        first_gt = np.where(gt[following], ends[following], -1) if len(lt) else np.zeros(0, int)
        end = end if most is None else np.minimum(end, most)
        if key[1] == key[2] == 0:  # what stands before the first `<`
            start, end, first_gt = start[1:], end[1:], first_gt[1:]
        length = end - start
        self.start, self.end, self.n = start, end, len(start)
        self.data = data = np.concatenate([data, np.zeros(room + 16, np.uint8)])
        self.bytes = data.tobytes()
        head = np.where(length > 0, data[start], 0)
        self.close = head == ord("/")
        self.opens = (head == ord("!")) & (length >= 8)
        at = np.flatnonzero(self.opens)
        same = np.ones(len(at), bool)
        for k, c in enumerate(b"![CDATA["):
            same &= data[start[at] + k] == c
        self.opens[at] = same
        self.mark = np.where(self.opens, 1, -1).astype(np.int8)
        p = np.flatnonzero(data[:-2] == ord("]"))
        p = p[(data[p + 1] == ord("]")) & (data[p + 2] == ord(">"))]
        of = np.searchsorted(start, p, "right") - 1
        self.mark[of[(of >= 0) & (p + 2 < end[of])] if self.n else []] = 0
        self.tag_end = self._tag_ends(np.where(first_gt < end, first_gt, -1))
        empty = ~self.close & (self.tag_end > start) & (data[self.tag_end - 1] == ord("/"))
        self.sign = np.where(self.close, -1, np.where(empty, 0, 1))
        marks = np.flatnonzero(self.mark >= 0)
        self.first_mark, self.last_mark = (int(marks[0]), int(self.mark[marks[-1]])) if len(marks) else (self.n, -1)

    def _tag_ends(self, found: np.ndarray) -> np.ndarray:
        """Where the `>` stands that ends each start tag, -1 where none does.  found: the first `>` of each record."""
        data, start = self.data, self.start
        self.quotes = [np.flatnonzero(data == quote) for quote in b"\"'"]
        if any(len(q) for q in self.quotes):
            of = [np.searchsorted(start, q, "right") - 1 for q in self.quotes]
            double, single = (np.bincount(k[(k >= 0) & (q < found[k])], minlength=self.n) if len(q) and self.n else np.zeros(self.n, int) for k, q in zip(of, self.quotes, strict=True))
            for r in np.flatnonzero(((double & 1) | (single & 1) | ((double > 0) & (single > 0))) & ~self.close):
                m = _START.match(b"<" + self.bytes[start[r] : self.end[r]])
                found[r] = start[r] + m.end() - 2 if m else -1
        return found

    def live(self, inside: bool) -> np.ndarray:
        """Tags outside CDATA, where the chunk begins inside a section or not."""
        last = np.maximum.accumulate(np.where(self.mark >= 0, np.arange(self.n), -1)) if self.n else np.zeros(0, int)
        last = np.concatenate([[-1], last[:-1]])[: self.n]
        return ~np.where(last >= 0, self.mark[last] == 1, inside) & ~self.opens if self.n else np.zeros(0, bool)

    def named(self, rows: np.ndarray, name: bytes, skip: int = 0) -> np.ndarray:
        at, end = self.start[rows] + skip, self.end[rows]
        ok = at + len(name) <= end
        for k, c in enumerate(name):
            ok &= self.data[at + k] == c
        return ok & ((at + len(name) == end) | _NAME_ENDS[self.data[at + len(name)]])

    def pieces(self, r: int, until: int) -> bytes:
        """The bytes of the records from r on, before `until`, as they stand."""
        return b"".join(b"<" + self.bytes[self.start[k] : self.end[k]] for k in range(r, until))

    def same(self, at: np.ndarray, end: np.ndarray, value: bytes) -> np.ndarray:
        """Whether the bytes from `at` on, before `end`, are the value."""
        ok = end - at == len(value)
        k = np.flatnonzero(ok)
        for j, c in enumerate(value):
            k = k[self.data[at[k] + j] == c]
        ok[:] = False
        ok[k] = True
        return ok

    def pass_(self, at: np.ndarray, end: np.ndarray, p: Attribute | Child, ok) -> np.ndarray:
        """Whether the bytes from `at` on, before `end`, are as asked."""
        if p.op in ("=", "!="):
            return self.same(at, end, p.value.encode()) == (p.op == "=")
        data = self.bytes
        return np.fromiter((ok(data[a:b]) for a, b in zip(at.tolist(), end.tolist(), strict=True)), bool, len(at))

    def attributes(self, rows: np.ndarray, p: Attribute, ok) -> np.ndarray:
        """`attribute` of many tags.  Where each `=` of a tag ends a name, begins a value in double quotes and stands in none, the values
        are found in the arrays; the other tags are read one by one."""
        good, data, (double, single) = np.zeros(len(rows), bool), self.data, self.quotes
        name, start, end = p.name.encode(), self.start[rows], self.tag_end[rows]
        plain = np.full(len(rows), bool(_ATTRIBUTE_NAME.fullmatch(name))) & (end >= 0)
        plain[plain] = np.searchsorted(single, start[plain]) == np.searchsorted(single, end[plain])
        at = np.flatnonzero(data == ord("="))
        of = np.searchsorted(start, at, "right") - 1
        at, of = (x[(of >= 0) & (at < end[of])] for x in (at, of)) if len(rows) else (at[:0], of[:0])
        inside = (np.searchsorted(double, at) - np.searchsorted(double, start[of])) & 1
        plain[of[(inside == 1) | (data[at + 1] != ord('"')) | _BLANKS[data[at - 1]]]] = False
        first = at - len(name)
        here = plain[of] & (first >= start[of])
        at, of, first = at[here], of[here], first[here]
        here = self.same(first, at, name) & ((first == start[of]) | ~_NAMES[data[first - 1]])
        value = np.full(len(rows), -1)
        value[of[here]] = at[here] + 2  # the last of a name stays
        k = np.flatnonzero(value >= 0)
        good[k] = self.pass_(value[k], double[np.searchsorted(double, value[k])], p, ok)
        for k in np.flatnonzero(~plain & (end >= 0)):
            good[k] = self.attribute(rows[k], p, ok)
        return good

    def attribute(self, r: int, p: Attribute, ok) -> bool:
        """Whether the tag has the attribute, its last one of that name, and that is as asked."""
        value = None
        for m in _ATTRIBUTE.finditer(self.bytes, self.start[r], self.tag_end[r] + 1) if self.tag_end[r] >= 0 else ():
            if m[1] == p.name.encode():
                value = m[2] if m[2] is not None else m[3]
        return value is not None and ok(value)

    def text(self, r: int, until: int) -> bytes:
        """The data of an open tag whose records end before `until`."""
        if until == r + 1 and self.tag_end[r] >= 0:
            return self.bytes[self.tag_end[r] + 1 : self.end[r]]
        return _SECTION.sub(rb"\1", _START.sub(b"", self.pieces(r, until), count=1))


class _Path:
    """The steps of a path as the scans need them."""

    def __init__(self, steps: list[Step]):
        self.steps, self.n = steps, len(steps)
        self.names = [s.name.encode() for s in steps]
        self.placed = [i for i, s in enumerate(steps) if isinstance(s.predicate, Index | Position | Last)]
        self.parents = [i for i, s in enumerate(steps) if isinstance(s.predicate, Child)]
        #: (depth, name) of the elements whose text is asked for
        self.texts = [(self.n - 1, self.names[-1])] + [(i + 1, steps[i].predicate.name.encode()) for i in self.parents]
        self.ok = {i: comparison(s.predicate.op, s.predicate.value) for i, s in enumerate(steps) if isinstance(s.predicate, Attribute | Child)}
        self.room = max(len(x) for x in [*self.names, *(name for _, name in self.texts)])

    def own(self, i: int, tags: _Tags, r: int) -> bool:
        p = self.steps[i].predicate
        return not isinstance(p, Attribute) or tags.attribute(r, p, self.ok[i])

    def place_ok(self, i: int, index, count):
        """What a step's place asks of the number among siblings, from 0, and of their count."""
        match self.steps[i].predicate:
            case Index(n):
                return index == n
            case Position(op, n):
                return OPS[op](index + 1, n)
            case Last(back):
                return index == count - 1 - back


@dataclass
class _Segment:
    """What records change, in depths relative to that before them.  opened: (depth, place, steps met) of the elements left open;
    head, tail: by (step, depth) the siblings whose parent began before, and whose parent is still open; first: the name that the first tag
    closes, "" if it closes none; last: (place, depth, texts named so) of the last tag."""

    delta: int
    low: int
    opened: list
    head: dict
    tail: dict
    first: bytes | None
    last: tuple | None


def _segment(tags: _Tags, path: _Path, live: np.ndarray, a: int, b: int) -> _Segment:
    rows = a + np.flatnonzero(live[a:b])
    if not len(rows):
        return _Segment(0, 0, [], {}, {}, None, None)
    sign = tags.sign[rows]
    run = np.cumsum(sign)
    depth = run - (sign == 1)
    after = np.minimum.accumulate(run[::-1])[::-1]
    before = np.minimum(np.concatenate([[0], np.minimum.accumulate(run)[:-1]]), 0)
    opened = []
    for k in np.flatnonzero((sign == 1) & (after == run)):
        met = [i for i in range(path.n) if tags.named(rows[k : k + 1], path.names[i])[0] and path.own(i, tags, rows[k])]
        opened.append((int(depth[k]), int(tags.start[rows[k]]), met))
    head, tail = {}, {}
    for i in path.placed:
        for sums, these in ((head, (sign >= 0) & (before >= depth)), (tail, (sign >= 0) & (after >= depth))):
            k = np.flatnonzero(these)
            levels, counts = np.unique(depth[k[tags.named(rows[k], path.names[i])]], return_counts=True)
            sums.update({(i, int(d)): int(c) for d, c in zip(levels, counts, strict=True)})
    first, last = rows[0], rows[-1:]
    closes = re.match(rb"/([^\s/>]*)", tags.bytes[tags.start[first] : tags.end[first]])[1] if tags.close[first] else b""
    texts = [i for i, (_, name) in enumerate(path.texts) if sign[-1] == 1 and tags.named(last, name)[0]]
    return _Segment(int(run[-1]), min(0, int(run.min())), opened, head, tail, closes, (int(tags.start[last[0]]), int(depth[-1]), texts))


def _changes(path: _Path, most: int):
    def run(batches):
        for key, data in _chunks(batches, most):
            tags = _Tags(key, data, path.room)
            live, cut = tags.live(False), min(tags.first_mark + 1, tags.n)
            parts = (_segment(tags, path, live, 0, cut), _segment(tags, path, live, cut, tags.n))
            state = pickle.dumps((tags.n, tags.last_mark, bool(tags.n and tags.opens[0]), parts, tags.bytes[:1] == b"<"))
            yield pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "number": [key[2]], "size": [tags.size], "state": [state]})

    return run


@dataclass
class _Begin:
    """How a chunk begins, and what the scan of it cannot see.  place: bytes before; levels: (offset, steps met, number among siblings) of the open
    element at each depth, or None; seen: by step the siblings so far; owner: the tag whose data the first records go on with, if its text is
    asked for; closes: the name that the next tag after the chunk closes; goes_on: the data of its last tag goes on after it."""

    place: int
    depth: int
    inside: bool
    levels: tuple
    seen: dict
    owner: int | None
    closes: bytes = b""
    goes_on: bool = False


@dataclass
class _Known:
    """By chunk how it begins; by (file, step, offset of the parent) the siblings in families of several chunks; by (file, step, offset) the
    elements of several chunks that have the child asked for; dangling: (file, offset, step, offset of the parent) of children whose text goes on;
    open: an element that may have such a child goes on after its chunk; parts: the bytes before each file of a document in parts, which counts as file 0."""

    begins: dict = field(default_factory=dict)
    totals: dict = field(default_factory=dict)
    met: set = field(default_factory=set)
    dangling: list = field(default_factory=list)
    open: bool = False
    parts: dict | None = None

    def file(self, file: int) -> int:
        return file if self.parts is None else 0


def _fold(rows: list, path: _Path, parts: dict[int, int] | None = None) -> _Known:
    known = _Known(parts=parts)
    rows = sorted(rows, key=lambda r: (r["file"] if parts is None else parts[r["file"]], r["block"], r["number"]))
    file = None
    for r in rows:
        if known.file(r["file"]) != file:
            if file is not None:
                _end(known, path, file, levels, seen)
            file, place, depth, inside, levels, seen, owner, more, waiting, before = known.file(r["file"]), 0, 0, False, [None] * path.n, defaultdict(int), None, False, [], None
        n, mark, opens, segments, at_tag = pickle.loads(r["state"])
        if parts is not None and r["block"] == r["number"] == 0:
            place = parts[r["file"]]
            if place and not at_tag:
                raise ValueError("a part of the document does not begin at a tag")
        goes_on = bool(n) and (inside or opens)
        more = more or goes_on  # the data of the last tag went on after its chunk
        if before is not None and n:
            before.goes_on = goes_on
        segments = [*([] if inside else segments[:1]), *(segments[1:] if mark >= 0 else [])]
        first = next((s.first for s in segments if s.first is not None), None)
        begin = known.begins[r["file"], r["block"], r["number"]] = _Begin(place, depth, inside, tuple(levels), dict(seen), owner[0] if goes_on and owner else None)
        if first is not None:
            for w in waiting:
                w.closes = first
            waiting = []
            if more and owner:
                known.dangling += [(file, owner[0], i, parent) for i, name, parent in owner[1] if name == first]
        for s in segments:
            low = depth + s.low
            for i in path.placed:
                seen[i] += s.head.get((i, i - depth), 0)
                if i and low < i:  # the family ends here
                    known.totals[file, i, levels[i - 1][0] if levels[i - 1] else None] = seen[i]
                    seen[i] = s.tail.get((i, i - depth), 0)
                elif i and not levels[i - 1]:
                    seen[i] = s.tail.get((i, i - depth), 0)
            levels = [x if d < low else None for d, x in enumerate(levels)]
            for d, at, met in s.opened:
                if 0 <= d + depth < path.n:
                    levels[d + depth] = (place + at - 1, met, seen[d + depth] - 1 if d + depth in path.placed else None)
            if s.last is not None:
                at, d, texts = s.last
                asked = [t for t in texts if path.texts[t][0] == d + depth]
                children = [(path.parents[t - 1], path.texts[t][1], levels[d + depth - 1][0]) for t in asked if t and levels[d + depth - 1]]
                owner, more = (place + at - 1, children) if asked else None, False
            depth += s.delta
        known.open |= any(levels[i] for i in path.parents)
        place += r["size"]
        inside = mark == 1 if mark >= 0 else inside
        waiting.append(begin)
        before = begin if n else before
    if file is not None:
        _end(known, path, file, levels, seen)
    return known


def _end(known: _Known, path: _Path, file: int, levels: list, seen: dict) -> None:
    for i in path.placed:
        known.totals[file, i, levels[i - 1][0] if i and levels[i - 1] else None] = seen[i]


class _Chunk:
    """A chunk in its place: which elements meet each step."""

    def __init__(self, tags: _Tags, path: _Path, key: tuple[int, int, int], known: _Known):
        self.tags, self.path, self.file, self.known, self.begin = tags, path, known.file(key[0]), known, known.begins[key]
        live = tags.live(self.begin.inside)
        self.rows = np.flatnonzero(live)
        sign = tags.sign[self.rows]
        self.run = self.begin.depth + np.cumsum(sign)
        depth = self.run - (sign == 1)
        #: by depth the places in rows of the elements that begin there, and the record of each
        self.at = [np.flatnonzero((depth == i) & (sign >= 0)) for i in range(path.n + bool(path.parents))]
        self.begun = [self.rows[k] for k in self.at]
        self.good, self.has = [], {}

    def offset(self, r):
        return self.begin.place + self.tags.start[r] - 1

    def after(self, k: np.ndarray) -> np.ndarray:
        """The record of the next tag after places in rows; the end of the chunk after the last."""
        return np.append(self.rows, self.tags.n)[k + 1]

    def parent(self, i: int) -> np.ndarray:
        """Of each element at depth i the number of its parent among those of the chunk, -1 for the one that was open before."""
        return np.searchsorted(self.begun[i - 1], self.begun[i]) - 1

    def open_at_end(self, i: int) -> bool:
        """Whether the last element at depth i is still open."""
        return len(self.at[i]) > 0 and self.tags.sign[self.begun[i][-1]] == 1 and self.run[self.at[i][-1] :].min() > i

    def children(self, i: int, wanted: np.ndarray) -> np.ndarray:
        """Of each element at depth i, and of the one open before (last), whether it has the child that step i asks for; only of wanted ones."""
        tags, name = self.tags, self.path.steps[i].predicate.name.encode()
        of, k, r = self.parent(i + 1), self.at[i + 1], self.begun[i + 1]
        these = np.flatnonzero(wanted[of] & (tags.sign[r] == 1))
        these = these[tags.named(r[these], name)]
        until = self.after(k[these])
        inner = until < tags.n
        leaf = np.full(len(these), self.begin.closes == name and not self.begin.goes_on)
        leaf[inner] = tags.close[until[inner]] & tags.named(until[inner], name, 1)
        these, until, ok = these[leaf], until[leaf], self.path.ok[i]
        r = r[these]
        good, plain = np.zeros(len(these), bool), (until == r + 1) & (tags.tag_end[r] >= 0)
        good[plain] = tags.pass_(tags.tag_end[r[plain]] + 1, tags.end[r[plain]], self.path.steps[i].predicate, ok)
        for k in np.flatnonzero(~plain):
            good[k] = ok(tags.text(int(r[k]), int(until[k])))
        has = np.zeros(len(self.begun[i]) + 1, bool)
        has[of[these[good]]] = True
        return has

    def resolve(self) -> np.ndarray:
        """The places in rows of the hits."""
        path, tags, begin = self.path, self.tags, self.begin
        good = None
        for i, step in enumerate(path.steps):
            r, level = self.begun[i], begin.levels[i]
            named = tags.named(r, path.names[i])
            of = self.parent(i) if i else np.full(len(r), -1)
            above = good[of] if i else np.ones(len(r), bool)
            ok = named & above
            before = level is not None and i in level[1] and (not i or bool(good[-1]))
            if i in path.placed:
                counts = np.concatenate([[0], np.cumsum(named)])
                parents = self.begun[i - 1] if i else np.zeros(0, int)
                base = np.append(counts[np.searchsorted(r, parents)], -begin.seen.get(i, 0))
                index, total = counts[1:] - 1 - base[of], None
                if isinstance(step.predicate, Last):
                    above_me = begin.levels[i - 1][0] if i and begin.levels[i - 1] else None
                    count = np.append(np.append(base[1:-1], counts[-1])[: len(parents)] - base[:-1], 0)
                    count[-1] = self.known.totals.get((self.file, i, above_me), 0)
                    if i and self.open_at_end(i - 1):
                        count[-2] = self.known.totals.get((self.file, i, int(self.offset(parents[-1]))), 0)
                    total = count[of]
                ok &= path.place_ok(i, index, total)
                before = before and bool(path.place_ok(i, level[2], self.known.totals.get((self.file, i, above_me), 0) if isinstance(step.predicate, Last) else None))
            elif i in path.parents:
                has = self.children(i, np.append(ok, False))
                if self.open_at_end(i):
                    has[-2] = (self.file, i, int(self.offset(r[-1]))) in self.known.met
                ok &= has[:-1]
                before = before and (self.file, i, level[0]) in self.known.met
            elif step.predicate:
                these = np.flatnonzero(ok)
                ok[these] = tags.attributes(r[these], step.predicate, path.ok[i])
            good = np.append(ok, before)
        return self.at[-1 - bool(path.parents)][good[:-1]]

    def crossing(self):
        """Yields (owner, step, place, data): steps met by a child of elements of several chunks, and the data of tags that goes on in other chunks."""
        tags, begin = self.tags, self.begin
        for i in self.path.parents:
            wanted = np.zeros(len(self.begun[i]) + 1, bool)
            wanted[-1] = begin.levels[i] is not None
            if len(wanted) > 1:
                wanted[-2] = self.open_at_end(i)
            has = self.children(i, wanted)
            if has[-1]:
                yield begin.levels[i][0], i, 0, None
            if len(has) > 1 and has[-2]:
                yield int(self.offset(self.begun[i][-1])), i, 0, None
        lead = int(self.rows[0]) if len(self.rows) else tags.n
        if begin.owner is not None and lead:
            yield begin.owner, -1, int(begin.place + tags.start[0]), tags.pieces(0, lead)
        if begin.goes_on and len(self.rows):
            last = self.rows[-1:]
            depth = self.run[-1] - 1
            if tags.sign[last[0]] == 1 and any(depth == d and tags.named(last, name)[0] for d, name in self.path.texts):
                yield int(self.offset(last[0])), -1, int(begin.place + tags.start[last[0]]), tags.pieces(int(last[0]), tags.n)

    def hits(self) -> pa.RecordBatch:
        """Rows (file, start_off, empty, text, tag, data): text is that of tags of one record, if all is ASCII; of others data are the records as they
        stand, without the start tag unless `tag` says so."""
        tags, k = self.tags, self.resolve()
        r, until = self.rows[k], self.after(k)
        size = until - r
        begins = np.cumsum(size) - size
        each = np.repeat(r - begins, size) + np.arange(size.sum())
        first, cut = tags.start[each] - 1, tags.tag_end[r] >= 0
        first[begins[cut]] = tags.tag_end[r[cut]] + 1
        length = tags.end[each] - first
        off = np.concatenate([[0], np.cumsum(length)])
        data = tags.data[np.repeat(first - off[:-1], length) + np.arange(off[-1])]
        whole = np.ones(len(each), bool)
        whole[begins[cut]] = False
        data[off[:-1][whole]] = ord("<")
        at = off[np.append(begins, len(each))].astype(np.int32)
        plain = cut & (size == 1) & (not len(data) or data.max() < 128)
        text, rest = (pa.Array.from_buffers(t, len(r), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())]) if these.any() else pa.nulls(len(r), t) for t, these in ((pa.string(), plain), (pa.binary(), ~plain)))
        if plain.any() and not plain.all():
            text, rest = (pc.if_else(pa.array(these), x, pa.scalar(None, x.type)) for these, x in ((plain, text), (~plain, rest)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), self.file)), pa.array(self.offset(r)), pa.array(tags.sign[r] == 0), text, pa.array(~cut), rest], names=["file", "start_off", "empty", "text", "tag", "data"])


def _scan(path: _Path, known: _Known, sizes: dict[int, int], most: int, crossing: bool):
    def run(batches):
        for key, data in _chunks(batches, most):
            tags = _Tags(key, data, path.room, sizes[key[0]] + (known.parts or {}).get(key[0], 0) - known.begins[key].place)
            chunk = _Chunk(tags, path, key, known)
            if not crossing:
                yield chunk.hits()
            elif found := list(chunk.crossing()):
                columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk.file] * len(found), pa.int64()), *columns], names=["file", "owner", "step", "place", "data"])

    return run


def _view(data: str) -> Column:
    return F.decode(F.col(data), "ISO-8859-1")


def _text(view: Column, tag: Column | None = None) -> Column:
    """tag: whether the start tag stands before the data."""
    data = F.regexp_replace(view, START_TAG, "")
    data = data if tag is None else F.when(tag, data).otherwise(view)
    data = F.when(F.contains(data, F.lit(CDATA_OPEN)), unwrap(data)).otherwise(data)
    return F.when(F.octet_length(data) == F.length(data), data).otherwise(from_bytes(data))  # ASCII


def large_path(spark: SparkSession, path: str, xpath: str, in_parts: bool = False, length: int | None = None) -> DataFrame:
    """Matches (file, start_off, text) of a path in large files.  text is the character data between the start tag and the next
    tag, CDATA sections unwrapped in their places.  Predicates mean what they mean in small documents.  in_parts: the files of the folder
    are one document, in the order of their names, and each begins at a `<`; offsets are those in the document, file is the folder.  length: the
    bytes of all files, unpacked, if they are known; it saves a scan that counts those of packed files."""
    steps = _Path(parse_xpath(xpath))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_path"), "length").withColumn("file", F.xxhash64("_path"))
    listed = sorted(files.collect(), key=lambda r: r["_path"])
    sizes = {r["file"]: r["length"] for r in listed}
    packed = any(_PACKED.search(r["_path"]) for r in listed)
    if packed and length is None:
        counted = records(spark, path, ENDS[-1]).groupBy("file").agg(F.sum(F.octet_length("value")).alias("n"))
        sizes = dict.fromkeys(sizes, 0) | {r["file"]: r["n"] - 1 for r in counted.collect()}
    for end in ENDS[::2] if in_parts else ENDS:  # `><` after a part could end a section that goes on in the next
        rows = records(spark, path, end)
        changes = rows.mapInArrow(_changes(steps, CHUNK), "file long, block long, number long, size long, state binary").collect()
        read = Counter()
        for r in changes:
            read[r["file"]] += r["size"]
        if end == ENDS[-1]:  # nothing but the last `<` stands after a file's end
            sizes = {f: max(0, read[f] - 1) for f in sizes}
        elif packed and length is not None:
            if sum(read.values()) - len(end) * len(read) == length:  # no row was left out, and no file ends with the end
                sizes = {f: max(0, read[f] - len(end)) for f in sizes}
                break
        elif all(read[f] in (n, n + len(end)) for f, n in sizes.items()):
            break
    names = [r["file"] for r in listed]
    parts = dict(zip(names, accumulate([0, *(sizes[f] for f in names)]), strict=False)) if in_parts else None
    known = _fold(changes, steps, parts)
    more = None
    if known.open or any(b.owner is not None for b in known.begins.values()):
        at = shared_path(spark, "crossing")
        rows.mapInArrow(_scan(steps, known, sizes, CHUNK, True), "file long, owner long, step int, place long, data binary").write.parquet(at)
        found = spark.read.schema("file long, owner long, step int, place long, data binary").parquet(at)
        known.met = {(r["file"], r["step"], r["owner"]) for r in found.where("step >= 0").collect()}
        parts = F.sort_array(F.collect_list(F.struct("place", _view("data").alias("data"))))
        more = found.where("step < 0").groupBy("file", F.col("owner").alias("start_off")).agg(_text(F.array_join(F.transform(parts, lambda p: p["data"]), "")).alias("text"))
        for i in steps.parents:
            p = steps.steps[i].predicate
            asked = {(f, o): (f, i, parent) for f, o, s, parent in known.dangling if s == i}
            if asked:
                passed = more.withColumn("name", F.lit(p.name)).where(child_condition(p)).select("file", "start_off").collect()
                known.met |= {asked[r["file"], r["start_off"]] for r in passed if (r["file"], r["start_off"]) in asked}
    hit = rows.mapInArrow(_scan(steps, known, sizes, CHUNK, False), "file long, start_off long, empty boolean, text string, tag boolean, data binary")
    text = F.when(F.col("data").isNull(), F.col("text")).otherwise(_text(_view("data"), F.col("tag")))
    if any(b.owner is not None for b in known.begins.values()):
        hit = hit.join(more.withColumnRenamed("text", "_more"), ["file", "start_off"], "left")
        text = F.coalesce("_more", text)
    if in_parts:
        return hit.select(F.lit(path).alias("file"), "start_off", F.when(~F.col("empty"), text).alias("text"))
    return hit.join(F.broadcast(files.drop("length")), "file").select(F.col("_path").alias("file"), "start_off", F.when(~F.col("empty"), text).alias("text"))

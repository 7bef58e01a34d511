r"""Personal data: patterns, and the terms that reveal what they protect.

Base spans come from four patterns (email, ip, card, phone), leftmost and non-overlapping for each kind.  Secrets (keys, tokens) join them as
protected entities: runs of 20 letters, digits and +/=_- or more that switch between letters and digits at least every eighth character,
which words and numbers do not.  Then information theory adds the words that give an entity away.  Over N documents,
with n(e), n(t), n(e,t) those that hold entity e, term t, both:

    information of e:  IC(e) = log N/n(e)
    disclosure of e by t:  PMI(e;t) = log N n(e,t) / (n(e) n(t)),  as a share of IC(e)

In a document with e, a term whose share reaches `remove` is removed, one that reaches `generalise` is replaced by its
class.  Counts cover all documents, and any entity that not all of them hold takes part, however many do.  A repeated text
counts once for each of its rows in N, n(e), n(t) and n(e,t).  Two kinds of pairs are judged:

* beside: t stands within `BESIDE` words of e.  n(e,t) counts the documents where it does.  One text is enough, so entities that stand
  once are protected too.  The chance that t, in as many texts as n(t) stands for, falls to e as often is at most exp(-m KL(r||q)), with r =
  n(e,t)/n(t), q = n(e)/N, and m the texts with both over r.
* anywhere in a document with e, for entities of two texts or more.  Here evidence must repeat: the first text with e and t makes them a
  pair, the others are the test.  With x different texts that hold both, x - 1 of the other n holders of t hold e, by chance
  each with probability q = (n(e) - 1) / (N - 1): at most exp(-n KL((x-1)/n || q)).

Either chance must not exceed `alpha` over the number of terms so met with e.  So a hot entity is not blamed for the rare words around it, and in a
table of some hundred rows, where one meeting proves little, nothing is added for entities that stand once.

Plan: one pass marks the documents that hold an entity and keeps each of their texts once, with its number and spans.
Pairs are added up in each task before the shuffle, so that a hot entity costs its documents and its different terms.  Terms that stand
in too many of the marked texts to tell an entity are left out before the rest are counted over all documents: a Bloom filter
of fixed size skips words that cannot be candidates, and the join with the candidates decides, so a full filter costs time only.
Terms go back to their texts by (entity, term).  Joins on entities and terms are salted.

Nulls: a null text is empty; rows with null id are treated like others.  Repeated rows get equal values, each in its own row.
An empty table gives an empty one.  Other columns are kept by `sanitise` and not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, Tally, hash_spans, hashed_words, mapped, mix, row_key, settle, small_batches, text_bytes

REMOVE, GENERALISE, ALPHA, BESIDE, SALTS = 0.95, 0.8, 0.05, 5, 16
BLOOM_BITS = 24
# The kinds and their patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "generalise", "remove")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = ".,;:!?\"'()[]{}|<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Emails from left to right.  The part before an @ is found backwards from it, so that plain words cost nothing; a match
    begins where its run of allowed characters begins, or where the match before ended."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _ips(text: str):
    """Dotted quads from left to right, found from their first dots: the digits before a dot belong to it alone."""
    end, at = 0, text.find(".")
    while at >= 0:
        start = at
        while start > end and "0" <= text[start - 1] <= "9":
            start -= 1
        if start < at and (m := _IP.match(text, start)):
            yield m
            end = m.end()
            at = text.find(".", end)
        else:
            at = text.find(".", at + 1)


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _ips(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of secrets that do not touch base spans."""
    out = []
    if not _DIGIT.search(text):
        return out
    for m in _SECRET.finditer(text):
        kinds = [c.isdigit() for c in m[0] if c.isalnum()]
        switches = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
        if 8 * switches >= len(kinds) and all(b <= m.start() or m.end() <= a for _, a, b in base):
            out.append(("secret", m.start(), m.end()))
    return out


def entity_name(kind: str, value: str) -> str:
    return kind + ":" + (value.lower() if kind in ("email", "ip") else value if kind == "secret" else re.sub("[^0-9]", "", value))


def _terms(text: str, spans) -> set[str]:
    """Different words outside the spans, without punctuation at their ends, of two characters or more."""
    return {t for w, _, _ in _free_words(text, spans) if len(t := w.strip(_TRIM)) > 1}


def _free_words(text: str, spans):
    taken = sorted((a, b) for _, a, b in spans)
    i = 0
    for m in _WORD.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            yield m[0], m.start(), m.end()


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _structs(found: list) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in found], _SPAN_TYPE)


def mark_base(docs: DataFrame, text_col="text", name="base_spans") -> DataFrame:
    """Adds the base spans and the secrets to each row."""
    small_batches(docs.sparkSession)
    n, at = len(docs.columns), docs.columns.index(text_col)
    schema = docs.withColumn(name, F.lit(None).cast(_SPANS)).schema

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], _structs([(x := base_spans(t or "")) + secret_spans(t or "", x) for t in b.column(at).to_pylist()])], names=schema.names)

    return docs.transform(mapped, run, schema)


def _names_of_row(text: str, spans, entity_filter: Bloom | None, term_filter: Bloom | None, with_terms=True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the different entities and terms of a text, those that pass the filters."""
    spans = [(s["kind"], s["start"], s["end"]) for s in spans]
    e = np.unique(np.array(term_names([entity_name(k, text[a:b]) for k, a, b in spans]), np.int64))
    e = e[entity_filter.test(e)] if entity_filter else e
    if not len(e) or not with_terms:
        return e, np.zeros(0, np.int64)
    t = np.unique(np.array(term_names(list(_terms(text, spans))), np.int64))
    return e, t[term_filter.test(t)] if term_filter else t


def _entities(texts: DataFrame) -> DataFrame:
    """Rows (_key, entity): the different entities of each text, as 64-bit names."""
    def run(batches):
        for b in batches:
            found = [_names_of_row(t, spans, None, None, False)[0] for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["_key", "entities"])

    return texts.select("_key", "_text", "_base").transform(mapped, run, "_key long, entities array<long>").select("_key", F.explode("entities").alias("entity"))


def _pairs(e: np.ndarray, t: np.ndarray, most: int = 1 << 20):
    """All pairs of the two, some at a time."""
    step = max(1, most // max(1, len(t)))
    for i in range(0, len(e), step):
        part = e[i : i + step]
        yield np.repeat(part, len(t)), np.tile(t, len(part))


def _beside(text: str, spans, width: int = BESIDE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the entities and terms of a text that stand within `width` words of each other, each pair once."""
    spans = sorted((s["start"], s["end"], s["kind"]) for s in spans)
    free = [(a, t) for w, a, _ in _free_words(text, [(k, a, b) for a, b, k in spans]) if len(t := w.strip(_TRIM)) > 1]
    if not free:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = np.array(term_names([t for _, t in free]), np.int64)
    at = np.searchsorted(np.array([a for a, _ in free]), [a for a, _, _ in spans])
    own = np.array(term_names([entity_name(k, text[a:b]) for a, b, k in spans]), np.int64)
    e, t = (np.concatenate(x) for x in zip(*[(np.full(len(near), o), near) for o, i in zip(own, at, strict=True) for near in [names[max(0, i - width) : i + width]]], strict=True))
    order = np.lexsort((t, e))
    e, t = e[order], t[order]
    first = np.concatenate([[True], (e[1:] != e[:-1]) | (t[1:] != t[:-1])])[: len(e)]
    return e[first], t[first]


def count_pairs(texts: DataFrame, entity_filter: Bloom) -> DataFrame:
    """Rows (entity, term, near, texts, n_et): how many texts hold both, and how many rows; near: beside each other, for all entities, else
    anywhere in the text, for those that pass the filter.  A task adds up what it meets and gives out
    early what passes a number of pairs, which bounds its memory."""
    sent = texts.sparkSession.sparkContext.broadcast(entity_filter)
    most = 1 << 20

    def run(batches):
        held, size = [], 0

        def merged():
            e, t, near, x, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((near, t, e))
            e, t, near, x, n = e[order], t[order], near[order], x[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (t[1:] != t[:-1]) | (near[1:] != near[:-1])]))
            return e[first], t[first], near[first], np.add.reduceat(x, first), np.add.reduceat(n, first)

        def out(columns):
            for i in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["entity", "term", "near", "texts", "n_et"])

        for b in batches:
            for text, spans, copies in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                kinds = [(1, *_beside(text, spans)), *((0, e, t) for e, t in _pairs(*_names_of_row(text, spans, sent.value, None)))]
                for near, e, t in kinds:
                    held.append((e, t, np.full(len(e), near), np.ones(len(e), np.int64), np.full(len(e), copies, np.int64)))
                    size += len(e)
                    if size > 2 * most:
                        held = [merged()]
                        size = len(held[0][0])
                        if size > most:
                            yield from out(held[0])
                            held, size = [], 0
        if size:
            yield from out(merged())

    found = texts.select("_text", "_base", "copies").transform(mapped, run, "entity long, term long, near long, texts long, n_et long")
    return found.groupBy("entity", "term", "near").agg(F.sum("texts").alias("texts"), F.sum("n_et").alias("n_et"))


def _rows_of_pairs(texts: DataFrame, entity_filter: Bloom, term_filter: Bloom) -> DataFrame:
    """Rows (_key, entity, term) of each text, of names that pass the filters."""
    sent = texts.sparkSession.sparkContext.broadcast((entity_filter, term_filter))

    def run(batches):
        for b in batches:
            for key, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for e, t in _pairs(*_names_of_row(text, spans, *sent.value), 1 << 16):
                    if len(e):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), key, np.int64)), pa.array(e), pa.array(t)], names=["_key", "entity", "term"])

    return texts.select("_key", "_text", "_base").transform(mapped, run, "_key long, entity long, term long")


def _join_salted(rows: DataFrame, by: str, few: DataFrame, on: list[str]) -> DataFrame:
    """rows join few, where many rows may share a value: they are dealt by the column `by` too, and few stands in each salt."""
    salt = F.explode(F.array([F.lit(i) for i in range(SALTS)])).alias("_salt")
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(few.select("*", salt), [*on, "_salt"]).drop("_salt")


def term_names(terms: list[str]) -> list[int]:
    """A term is the hash of its bytes, A-Z as a-z."""
    if not terms:
        return []
    data, off = text_bytes(pa.array(terms, pa.string()))
    return hash_spans(data, off[:-1], off[1:], lower=True).view(np.int64).tolist()


class Bloom:
    """A set of 64-bit names, of fixed size; may say yes wrongly, never no."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(names.view(np.uint64))
        return (h & _U((1 << BLOOM_BITS) - 1)).astype(np.int64), (h >> _U(64 - BLOOM_BITS)).astype(np.int64)

    def test(self, names: np.ndarray) -> np.ndarray:
        a, b = self.places(names)
        return (self.bits[a >> 3] >> (a & 7).astype(np.uint8) & self.bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def build_bloom(names: DataFrame) -> Bloom:
    """names: one long column.  Each task sends the bits it sets, by place; the result has a fixed size."""
    def run(batches):
        seen = np.zeros(1 << BLOOM_BITS, bool)
        for b in batches:
            for p in Bloom.places(b.column(0).to_numpy()):
                seen[p] = True
        bits = np.packbits(seen, bitorder="little")
        words = bits.view(np.int64)
        full = np.flatnonzero(words)
        for i in range(0, len(full), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(full[i : i + (1 << 16)]), pa.array(words[full[i : i + (1 << 16)]])], names=["place", "bits"])

    found = names.transform(mapped, run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((1 << BLOOM_BITS) // 64, np.int64)
    words[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return Bloom(words.view(np.uint8))


def count_beside(texts: DataFrame, term_filter: Bloom) -> DataFrame:
    """Rows (term, n_p): how many of the texts hold each term that passes the filter, which n(t) is at least."""
    sent = texts.sparkSession.sparkContext.broadcast(term_filter)

    def run(batches):
        for b in batches:
            found = []
            for text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = np.unique(np.array(term_names(list(_terms(text, [(s["kind"], s["start"], s["end"]) for s in spans]))), np.int64))
                found.append(t[sent.value.test(t)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["term"])

    return texts.select("_text", "_base").transform(mapped, run, "term long").groupBy("term").agg(F.count("*").alias("n_p"))


def count_terms(docs: DataFrame, text_col: str, bloom: Bloom) -> DataFrame:
    """n(t) over all rows, for the terms that pass the filter.  A term is counted in a row where it stands outside base
    spans, or would if there were any: base spans hold no candidate but by chance."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        tally = Tally()
        for b in batches:
            for _, rows, _, starts, ends, data in hashed_words(b.column(0)):
                starts, ends = trim_spans(data, starts, ends)
                h = hash_spans(data, starts, ends, lower=True)
                hit = np.flatnonzero(sent.value.test(h) & (ends > starts))
                if len(hit):
                    row, found = np.searchsorted(rows, hit, "right"), h[hit]
                    order = np.lexsort((found, row))
                    row, found = row[order], found[order]
                    yield from tally.add(found[np.concatenate([[True], (row[1:] != row[:-1]) | (found[1:] != found[:-1])])])
        yield from tally.rest()

    return docs.select(text_col).transform(mapped, run, "name long, n long").groupBy(F.col("name").alias("term")).agg(F.sum("n").alias("n_t"))


_TRIM_BYTES = np.zeros(256, bool)
_TRIM_BYTES[list(_TRIM.encode())] = True


def trim_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without punctuation at either end."""
    keep = ~_TRIM_BYTES[data]
    place = np.flatnonzero(keep)
    if not len(place):
        return starts, starts
    first = np.searchsorted(place, starts)
    last = np.searchsorted(place, ends) - 1
    ok = last >= first
    a = np.where(ok, place[np.minimum(first, len(place) - 1)], starts)
    return a, np.where(ok, place[np.maximum(last, 0)] + 1, a)


def log_chance(x, n, q):
    """Logarithm of a bound on the chance of x or more hits in n trials of probability q < 1 (Chernoff); 0 where x is no more than expected."""
    n = F.greatest(n.cast("double"), x.cast("double"), F.lit(1.0))
    r = x / n
    part = lambda a, b: F.when((a > 0) & (b > 0), a * F.log(a / F.greatest(b, F.lit(1e-300)))).otherwise(0.0)
    return F.when((x <= 0) | (r <= q), 0.0).otherwise(-n * (part(r, q) + part(1 - r, 1 - q)))


def disclosing_terms(docs: DataFrame, texts: DataFrame, text_col="text", generalise=GENERALISE, alpha=ALPHA) -> DataFrame:
    """Rows (_key, term, share): the terms that give an entity of that text away, with the largest share.  texts: each
    text with an entity once: _key, _text, _base, copies."""
    total = docs.count()
    held = _entities(texts).join(texts.select("_key", "copies"), "_key")
    known = held.groupBy("entity").agg(F.count("*").alias("_texts"), F.sum("copies").alias("n_e"))
    known = settle(known.where(F.col("n_e") < total), "private-entities")
    pairs = settle(count_pairs(texts, build_bloom(known.where("_texts > 1").select("entity"))), "private-pairs")
    known = known.drop("_texts").join(pairs.groupBy("entity", "near").agg(F.count("*").alias("terms")), "entity")
    near, log_n = F.col("near") == 1, F.lit(float(total))
    most = F.log(F.lit(alpha) / F.col("terms"))
    share = lambda n_t: F.log(log_n * F.col("n_et") / (F.col("n_e") * n_t)) / F.log(log_n / F.col("n_e"))
    repeated = lambda n_t: log_chance(F.col("texts") - 1, n_t - F.col("n_et") + F.col("texts") - 1, (F.col("n_e") - 1) / F.lit(float(max(total - 1, 1))))
    beside = lambda n_t: log_chance(F.col("texts"), F.col("texts") * n_t / F.col("n_et"), F.col("n_e") / log_n)
    fits = lambda n_t: (F.when(near, beside(n_t)).otherwise(repeated(n_t)) <= most + 1e-9) & (share(n_t) >= generalise)
    # both fall with n(t): what fails with fewer than n(t), as n(e,t) and the texts with an entity are, needs no count over all documents
    both = _join_salted(pairs.where(near | (F.col("texts") > 1)), "term", known, ["entity", "near"]).where(fits(F.col("n_et")))
    both = settle(both, "private-terms")
    few = count_beside(texts, build_bloom(both.select("term").distinct()))
    both = settle(_join_salted(both, "entity", few, ["term"]).where(fits(F.greatest("n_p", "n_et"))).drop("n_p"), "private-terms")
    if both.isEmpty():
        return both.select(F.lit(0).cast("long").alias("_key"), "term", F.lit(0.0).alias("share")).limit(0)
    counts = count_terms(docs, text_col, build_bloom(both.select("term").distinct()))
    n_t = F.greatest("n_t", "n_et")
    scored = _join_salted(both, "entity", counts, ["term"]).where(fits(n_t))
    telling = settle(scored.groupBy("entity", "term").agg(F.max(share(n_t)).alias("share")), "private-telling")
    rows = _rows_of_pairs(texts, build_bloom(telling.select("entity").distinct()), build_bloom(telling.select("term").distinct()))
    return _join_salted(rows, "_key", telling, ["entity", "term"]).groupBy("_key", "term").agg(F.max("share").alias("share"))


def personal_spans(docs: DataFrame, id_col="doc_id", text_col="text", remove=REMOVE, generalise=GENERALISE, alpha=ALPHA) -> DataFrame:
    """Each row of docs with `base_spans` and `spans` (base and method), both by kind as in KINDS, then start."""
    text_at = f"c{docs.columns.index(text_col)}"
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)  # names of our own, whatever the columns are called
    keyed = plain.withColumn("_text", F.coalesce(F.col(text_at), F.lit(""))).withColumn("_key", row_key("_text"))
    marked = mark_base(keyed.select("_key", "_text"), "_text", "_base").where(F.size("_base") > 0)
    stored = settle(marked.groupBy("_key").agg(F.first("_text").alias("_text"), F.first("_base").alias("_base"), F.count("*").alias("copies")), "private-texts")
    terms = disclosing_terms(plain, stored, text_at, generalise, alpha)
    listed = terms.groupBy("_key").agg(F.collect_list("term").alias("_terms"), F.collect_list("share").alias("_shares"))

    def run(batches):
        for b in batches:
            first, found = [], []
            for text, base, hashes, shares in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                first.append([s for s in spans if s[0] != "secret"])
                if hashes:
                    level = dict(zip(hashes, shares, strict=True))
                    free = [(t, a + w.index(t), a + w.index(t) + len(t)) for w, a, _ in _free_words(text, spans) if len(t := w.strip(_TRIM)) > 1]
                    hashed = term_names([t for t, _, _ in free])
                    added = [("remove" if level[h] >= remove else "generalise", a, e) for h, (_, a, e) in zip(hashed, free, strict=True) if h in level]
                    spans += sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))
                found.append(spans)
            yield pa.RecordBatch.from_arrays([b.column(0), _structs(first), _structs(found)], names=["_key", "base_spans", "spans"])

    told = stored.join(listed, "_key", "left").select("_key", "_text", "_base", "_terms", "_shares")
    told = settle(told.transform(mapped, run, f"_key long, base_spans {_SPANS}, spans {_SPANS}"), "private-spans")
    sent = docs.sparkSession.sparkContext.broadcast(build_bloom(told.select("_key")))

    @F.arrow_udf("boolean")
    def may_be_private(key: pa.Array) -> pa.Array:
        return pa.array(sent.value.test(key.to_numpy(zero_copy_only=False)))

    # texts without spans stay where they are, but for those that the filter lets through by chance
    rows = keyed.select(*names, "_key").withColumn("_hit", may_be_private("_key"))
    none = F.array().cast(_SPANS)
    private = rows.where("_hit").join(told, "_key", "left").select(*names, F.coalesce("base_spans", none).alias("base_spans"), F.coalesce("spans", none).alias("spans"))
    rest = rows.where("NOT _hit").select(*names, none.alias("base_spans"), none.alias("spans"))
    return private.unionByName(rest).toDF(*docs.columns, "base_spans", "spans")


def sanitise(found: DataFrame, text_col="text") -> DataFrame:
    """Base and generalised spans become [KIND], removed ones go; overlapping spans merge under the first.  found has the spans as
    its last two columns, which are dropped."""
    columns = found.columns[:-2]
    n, at = len(columns), columns.index(text_col)
    plain = found.toDF(*[f"c{i}" for i in range(n + 2)])
    schema = plain.select(plain.columns[:n]).schema

    def clean(text, spans):
        if not spans or text is None:
            return text
        out, end = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= end:
                label = {"remove": "", "generalise": "[NUMBER]" if text[s["start"]].isdigit() else "[TERM]"}.get(s["kind"], f"[{s['kind'].upper()}]")
                out += [text[end : s["start"]], label]
            end = max(end, s["end"])
        return "".join(out) + text[end:]

    def run(batches):
        for b in batches:
            new = pa.array([clean(t, s) for t, s in zip(b.column(at).to_pylist(), b.column(n + 1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(n)], names=schema.names)

    return plain.transform(mapped, run, schema).toDF(*columns)


def _line(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_pii_disclosure(spark, sf_dir: str) -> DataFrame:
    found = personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS[:4]], F.sha2(_line("base_spans").cast("binary"), 256).alias("base_sha256"), _line("spans").alias("spans"))


def stage_private(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sanitised documents; n_chars follows the text where the table has it."""
    out = sanitise(personal_spans(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

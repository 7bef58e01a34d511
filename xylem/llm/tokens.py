"""Token ids of whole texts with a public byte-level BPE vocabulary, fast for corpora.

A byte-level BPE never merges across its pre-tokens, and none of these holds white space after another character.  So a
text may be cut before each white space that follows an ASCII character or one from À to ÿ, and each distinct piece needs encoding once; numpy
names the pieces by hash and puts the ids together.  Strings of special tokens in a text are what the vocabulary file makes of them;
they hold no white space, so that none lies across a cut.

Most pieces are a space or line end and Latin letters, digits and marks, whose runs are the pre-tokens.  Such pieces go to the same model written in
the characters of a byte-level vocabulary, their pre-tokens set apart by spaces, so that the library need not search for them.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import _SPACE, blocks, hash_spans, text_bytes

MEMO = 600_000  # pieces that a worker remembers before it lets go of those that it met once
_encoders: dict[str, PieceEncoder] = {}
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"  # not ', which begins contractions, and not |, which special tokens have
_PLAIN = re.compile(f"[ \n][A-Za-zÀ-ÖØ-öø-ÿ0-9{re.escape(_MARKS)}]+")
_KIND = np.full(256, 2, np.uint8)  # of a byte of a plain piece: space, line end, letter, digit, mark
_KIND[32], _KIND[10], _KIND[48:58], _KIND[list(_MARKS.encode())] = 0, 1, 3, 4
#: The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on.
_SEEN = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
_CHARACTER = np.where(_SEEN, np.arange(256), 255 + np.cumsum(~_SEEN)).astype("<u2")


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.split = None  # the same model for pre-tokens set apart by spaces, where the vocabulary cuts texts as is assumed here
        model = made["model"]
        usual = made["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if usual and not made["normalizer"] and model["type"] == "BPE" and not any(v for k, v in model.items() if k not in ("type", "vocab", "merges")):
            merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
            self.split = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))  # a piece comes once
            self.split.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()  # in a byte-level vocabulary a character stands for a byte
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.sizes[i] = len(token.content.encode())
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.lengths = np.zeros(1 << 12, np.int64)
        self.begins = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.met = np.zeros(1 << 12, np.int32)
        self.used = 0

    def thin(self) -> None:
        """Keeps the pieces that came again since the last time; if these are too many, none."""
        n = len(self.place)
        again = np.flatnonzero(self.met[:n] > 1)
        if len(again) > MEMO // 2:
            return self.forget()
        names = np.empty(n, np.int64)
        names[np.fromiter(self.place.values(), np.int64, n)] = np.fromiter(self.place, np.uint64, n).view(np.int64)
        sizes, begins, ids = self.lengths[again], self.begins[again], self.ids
        stops = np.cumsum(sizes)
        kept = ids[np.repeat(begins - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        self.forget()
        self._store(names[again].view(np.uint64).tolist(), sizes, kept)

    def _ids(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece.  Pieces that begin with white space and end with something else are encoded in one string, as
        no token spans them there; the tokens' lengths in bytes then tell where each piece ends."""
        found: list = [None] * len(pieces)
        plain = [k for k, p in enumerate(pieces) if _PLAIN.fullmatch(p)] if self.split else []
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            raw = np.frombuffer("".join([pieces[k] for k in part]).encode(), np.uint8)
            kind = _KIND[raw]
            first = kind < 2
            first[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] > 0)
            apart = np.full(len(raw) + np.count_nonzero(first), ord(" "), "<u2")
            apart[np.arange(len(raw)) + np.cumsum(first)] = _CHARACTER[raw]
            ids = np.array(self.split.encode_batch_fast([apart.tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, np.uint32)
            self._deal(found, part, ids, np.append(np.flatnonzero(kind < 2)[1:], len(raw)))
        joined = [k for k, p in enumerate(pieces) if found[k] is None and p[0] in " \n\t\r\x0b\x0c" and not p[-1].isspace()]
        for k in set(range(len(pieces))).difference(joined, plain):
            found[k] = np.array(self.tokenizer.encode(pieces[k], add_special_tokens=False).ids, np.uint32)
        for i in range(0, len(joined), 4096):
            part = joined[i : i + 4096]
            ids = np.array(self.tokenizer.encode("".join([pieces[k] for k in part]), add_special_tokens=False).ids, np.uint32)
            self._deal(found, part, ids, np.cumsum([len(pieces[k].encode()) for k in part]))
        return found

    def _deal(self, found: list, part: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        """Gives each piece of part its ids; ends: the bytes up to the end of each."""
        stops = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1).tolist()
        for k, a, b in zip(part, [0, *stops[:-1]], stops, strict=True):
            found[k] = ids[a:b]

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        found = self._ids(pieces)
        self._store(hashes, np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found))

    def _store(self, hashes: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, k, total = len(self.place), len(hashes), len(ids)
        if n + k > len(self.lengths):
            grow = max(len(self.lengths), k)
            self.lengths, self.begins, self.met = (np.concatenate([x, np.zeros(grow, x.dtype)]) for x in (self.lengths, self.begins, self.met))
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        self.lengths[n : n + k] = sizes
        self.begins[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.met[n : n + k] = 0
        self.ids[self.used : self.used + total] = ids
        self.used += total
        self.place.update(zip(hashes, range(n, n + k), strict=True))

    def encode(self, column):
        """Yields for ranges of rows: first row, offsets of the rows in the ids, the ids."""
        data, off = text_bytes(column)
        for i, j in blocks(off):
            part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            yield i, *self._block(part, at)

    def _block(self, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(part):
            return np.zeros(len(at), np.int64), np.zeros(0, np.uint32)
        space = _SPACE[part]
        cut = np.zeros(len(part) + 1, bool)
        known = part[:-1] < 128
        known[1:] |= part[:-2] == 0xC3  # À to ÿ; elsewhere what stands before may be white space too
        cut[1:-1] = space[1:] & ~space[:-1] & known
        cut[at] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        names, first, which = np.unique(hash_spans(part, starts, ends), return_index=True, return_inverse=True)
        if len(self.place) > MEMO:
            self.thin()
        keys = names.tolist()
        get = self.place.get
        where = [get(k, -1) for k in keys]
        new = [k for k, w in enumerate(where) if w < 0]
        if new:
            raw = part.tobytes()
            s, e = starts[first].tolist(), ends[first].tolist()
            self._learn([keys[k] for k in new], [raw[s[k] : e[k]].decode("utf-8", "replace") for k in new])
            for k in new:
                where[k] = self.place[keys[k]]
        where = np.array(where, np.int64)
        self.met[where] += 1
        spot = where[which]
        sizes = self.lengths[spot]
        stops = np.cumsum(sizes)
        pick = np.repeat(self.begins[spot] - (stops - sizes), sizes) + np.arange(stops[-1])
        total = np.concatenate([[0], stops])
        return total[np.searchsorted(starts, at)], self.ids[pick]

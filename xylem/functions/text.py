"""Column functions on the byte view of documents.

The byte view is the content decoded as ISO-8859-1: one character for each byte, so that lengths and positions are in bytes.
All markup is ASCII; what is cut out is decoded again with `from_bytes`.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CDATA_OPEN, CDATA_CLOSE = "<![CDATA[", "]]>"
_CDATA = r"<!\[CDATA\[(?s:.*?)(?:\]\]>|\z)"
# A tag with the character data and CDATA sections after it; text or CDATA before the first tag.
PIECES = rf"<(?!!\[CDATA\[)[^<]*(?:{_CDATA}[^<]*)*+|[^<]+|{_CDATA}"
START_TAG = r"""\A<(?:[^>"']|"[^"]*"|'[^']*')*+>"""
NAME = r"\A</?([^\s/>]*)"
ATTRIBUTE = r"""([\w.:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_SECTIONS = r"(?=<!\[CDATA\[)|(?<=\]\]>)"
TOKENS = r"""(?=<(?!/)|="|/>)|(?<=<)(?=/)"""


def byte_view(content: Column, is_binary: bool = False) -> Column:
    return F.decode(content if is_binary else F.encode(content, "UTF-8"), "ISO-8859-1")


def from_bytes(piece: Column) -> Column:
    """Text of a slice of the byte view; plain ASCII, the common case, is returned as it is."""
    return F.when(piece.rlike(r"[^\x00-\x7F]"), F.decode(F.encode(piece, "ISO-8859-1"), "UTF-8")).otherwise(piece)


def mask_cdata(view: Column) -> Column:
    """The view with each CDATA section replaced by as many blanks."""
    blank = lambda s: F.when(F.startswith(s, F.lit(CDATA_OPEN)), F.repeat(F.lit(" "), F.length(s))).otherwise(s)
    return F.when(F.contains(view, F.lit(CDATA_OPEN)), F.array_join(F.transform(F.split(view, _SECTIONS), blank), "")).otherwise(view)


def mask_misc(view: Column) -> Column:
    """The view with comments, processing instructions and DOCTYPE replaced by as many blanks (opt-in)."""
    misc = r"(?s)(?=<!--|<\?|<!DOCTYPE)|(?<=-->)|(?<=\?>)|(?<=>)(?<!-->)(?<!\?>)"
    gone = lambda s: F.startswith(s, F.lit("<!--")) | F.startswith(s, F.lit("<?")) | F.startswith(s, F.lit("<!DOCTYPE"))
    return F.array_join(F.transform(F.split(view, misc), lambda s: F.when(gone(s), F.repeat(F.lit(" "), F.length(s))).otherwise(s)), "")


def unwrap(data: Column) -> Column:
    """Character data without the CDATA wrappers."""
    return F.regexp_replace(data, r"<!\[CDATA\[((?s:.*?))(?:\]\]>|\z)", "$1")


def decode_entities(text: Column) -> Column:
    """The five predefined entities; `&amp;` last, so that nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def attributes(start_tag: Column) -> Column:
    """Map of the attributes of a start tag; the last of equal names stays."""
    found = F.regexp_extract_all(start_tag, F.lit(ATTRIBUTE), F.lit(0))
    name = lambda a: from_bytes(F.regexp_extract(a, r"\A[\w.:-]+", 0))
    value = lambda a: from_bytes(F.regexp_replace(a, r"""(?s)\A[\w.:-]+\s*=\s*["']|["']\z""", ""))
    keys = F.transform(found, name)
    last = F.filter(F.transform(found, lambda a, i: F.struct(name(a).alias("k"), value(a).alias("v"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.greatest(F.size(keys), F.lit(1))), e["k"]))
    repeated = F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))
    plain = F.map_from_arrays(keys, F.transform(found, value))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(~F.contains(start_tag, F.lit("=")), none).when(F.size(F.array_distinct(keys)) == F.size(keys), plain).otherwise(repeated)


def compare(left: Column, op: str, value: str) -> Column:
    """Equality by bytes; order by number where both sides are numbers, else by bytes."""
    if op in ("=", "!="):
        return (left == value) if op == "=" else (left != value)
    try:
        number, wanted = left.try_cast("double"), float(value)
        numeric = {"<": number < wanted, ">": number > wanted, "<=": number <= wanted, ">=": number >= wanted}[op]
    except ValueError:
        number, numeric = F.lit(None), F.lit(None).cast("boolean")
    text = {"<": left < value, ">": left > value, "<=": left <= value, ">=": left >= value}[op]
    return F.when(number.isNotNull(), numeric).otherwise(text)


_NUMBER = re.compile(rb"([+-]?)(?:(NaN)|(Infinity)|((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[fFdD]?|(0[xX](?:[0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?\d+)[fFdD]?)")
_WORDS = {b"nan": float("nan"), b"inf": float("inf"), b"+inf": float("inf"), b"infinity": float("inf"), b"+infinity": float("inf"), b"-inf": float("-inf"), b"-infinity": float("-inf")}
_BLANKS = bytes(range(33))


def number(text: bytes) -> float | None:
    """What try_cast(text AS DOUBLE) gives."""
    text = text.strip(_BLANKS)
    m = _NUMBER.fullmatch(text)
    if not m:
        return _WORDS.get(text.lower())
    try:
        value = float("nan") if m[2] else float("inf") if m[3] else float(m[4]) if m[4] else float.fromhex(m[5].decode())
    except OverflowError:
        value = float("inf")
    return -value if m[1] == b"-" else value


def comparison(op: str, value: str) -> Callable[[bytes], bool]:
    """The condition of `compare` on the bytes of a text."""
    if op in ("=", "!="):
        return ((lambda left, wanted=value.encode(): left == wanted) if op == "=" else (lambda left, wanted=value.encode(): left != wanted))
    holds, text = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}[op], value.encode()
    ordered = lambda x: (x != x, 0.0 if x != x else x)  # noqa: E731 - NaN is above all numbers and equal to itself
    try:
        wanted = ordered(float(value))
    except ValueError:
        return lambda left: holds(left, text)

    known: dict[bytes, bool] = {}  # lru_cache would not travel to the workers

    def ok(left: bytes) -> bool:
        if left not in known:
            if len(known) >= 1 << 16:
                known.clear()
            x = number(left)
            known[left] = holds(left, text) if x is None else holds(ordered(x), wanted)
        return known[left]

    return ok

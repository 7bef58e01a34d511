"""The path language: `/name[predicate]/name...` with at most one predicate a step.

predicate = @name op 'value' | name op value | n (from 0) | position() op n (from 1) | last() | last() - n
op = = != < > <= >=; values bare or in either quotes.  A leading and a trailing slash are optional.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class XPathSyntaxError(ValueError):
    """The path is not in the language."""


@dataclass(frozen=True)
class Attribute:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Child:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Index:
    n: int


@dataclass(frozen=True)
class Position:
    op: str
    n: int


@dataclass(frozen=True)
class Last:
    back: int


Predicate = Attribute | Child | Index | Position | Last


@dataclass(frozen=True)
class Step:
    name: str
    predicate: Predicate | None = None


_NAME = r"[\w.:-]+"
_OP = r"(!=|<=|>=|=|<|>)"
_STEP = re.compile(rf"""\s*({_NAME})\s*(?:\[((?:[^\]'"]|'[^']*'|"[^"]*")*)\])?\s*(/|\Z)""")
_ATTRIBUTE = re.compile(rf"""@({_NAME})\s*{_OP}\s*(?:'([^']*)'|"([^"]*)")\Z""")
_CHILD = re.compile(rf"""({_NAME})\s*{_OP}\s*(?:'([^']*)'|"([^"]*)"|([^\s'"\[\]]+))\Z""")
_POSITION = re.compile(rf"position\(\)\s*{_OP}\s*(\d+)\Z")
_LAST = re.compile(r"last\(\)\s*(?:-\s*(\d+))?\Z")


def parse_predicate(text: str) -> Predicate:
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return Index(int(text))
    if m := _POSITION.match(text):
        return Position(m[1], int(m[2]))
    if m := _LAST.match(text):
        return Last(int(m[1] or 0))
    if m := _ATTRIBUTE.match(text):
        return Attribute(m[1], m[2], next(v for v in m.groups()[2:] if v is not None))
    if m := _CHILD.match(text):
        return Child(m[1], m[2], next(v for v in m.groups()[2:] if v is not None))
    raise XPathSyntaxError(f"not a predicate: [{text}]")


def parse_xpath(path: str) -> list[Step]:
    at, end = 0, len(path.rstrip())
    at += path[:1] == "/"
    steps = []
    while at < end:
        m = _STEP.match(path, at)
        if not m:
            raise XPathSyntaxError(f"not a step: {path[at:]!r}")
        steps.append(Step(m[1], None if m[2] is None else parse_predicate(m[2])))
        at = m.end()
    if not steps:
        raise XPathSyntaxError("an empty path")
    return steps

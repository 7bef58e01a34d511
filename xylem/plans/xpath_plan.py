"""Paths as DataFrame plans over an element table.

Two plans give the same rows.  `window`: in document order the last element begun at depth i is the ancestor there, so a single
window per document carries the verdict of each step down to its descendants; no join, no exchange beyond the one by
document.  `join`: each step keeps the elements of its name and predicate, and semi-joins go down by parent; best on a
stored element table, where filters reach the scan and few rows are left to join.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compare
from .xpath_ast import Attribute, Child, Index, Last, Position, Step, parse_xpath


OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def own_condition(step: Step, affix_compat: bool = False) -> Column:
    """What an element's own row tells of a step."""
    ok = F.col("name") == step.name
    match step.predicate:
        case Attribute(name, op, value):
            left = F.col("attrs")[name]
            ok &= F.startswith(left, F.lit(value)) if affix_compat and op == "=" else compare(left, op, value)
        case Index(n):
            ok &= F.col("sibling_idx") == n
        case Position(op, n):
            ok &= OPS[op](F.col("sibling_idx") + 1, n)
        case Last(back):
            ok &= F.col("sibling_idx") == F.col("sibling_count") - 1 - back
    return F.coalesce(ok, F.lit(False))


def child_condition(p: Child, affix_compat: bool = False) -> Column:
    left = F.col("text")
    return (F.col("name") == p.name) & (F.endswith(left, F.lit(p.value)) if affix_compat and p.op == "=" else compare(left, p.op, p.value))


def _join_plan(elements: DataFrame, steps: list[Step], id_col: str, affix_compat: bool) -> DataFrame:
    above = None
    for i, step in enumerate(steps):
        here = elements.where((F.col("depth") == i) & own_condition(step, affix_compat))
        if isinstance(step.predicate, Child):
            child = elements.where((F.col("depth") == i + 1) & child_condition(step.predicate, affix_compat)).select(id_col, F.col("parent_id").alias("elem_id"))
            here = here.join(child, [id_col, "elem_id"], "left_semi")
        if above is not None:
            here = here.join(above.select(id_col, F.col("elem_id").alias("parent_id")), [id_col, "parent_id"], "left_semi")
        above = here
    return above


def _window_plan(elements: DataFrame, steps: list[Step], id_col: str, affix_compat: bool) -> DataFrame:
    n = len(steps)
    has_child = [i for i, s in enumerate(steps) if isinstance(s.predicate, Child)]
    rows = elements.where(F.col("depth") < n + bool(has_child))
    order = Window.partitionBy(id_col).orderBy("start_off")
    at = lambda i: F.col("depth") == i
    if has_child:
        rows = rows.withColumns({f"_anc{i}": F.last(F.when(at(i), F.col("start_off")), ignorenulls=True).over(order) for i in has_child})
        flag = lambda i: F.coalesce(at(i + 1) & child_condition(steps[i].predicate, affix_compat), F.lit(False))
        rows = rows.withColumns({f"_has{i}": F.max(flag(i)).over(Window.partitionBy(id_col, f"_anc{i}")) for i in has_child})
    ok = {i: own_condition(s, affix_compat) & (F.col(f"_has{i}") if i in has_child else F.lit(True)) for i, s in enumerate(steps)}
    rows = rows.withColumns({f"_ok{i}": F.last(F.when(at(i), ok[i]), ignorenulls=True).over(order) for i in range(n)})
    matched = at(n - 1)
    for i in range(n):
        matched &= F.col(f"_ok{i}")
    return rows.where(matched).select(*elements.columns)


def compile_xpath(elements: DataFrame, path: str, id_col: str = "doc_id", strategy: str = "auto", affix_compat: bool = False) -> DataFrame:
    """The elements that the path selects.  strategy: window, join, or auto (window for paths without predicates)."""
    steps = parse_xpath(path)
    if strategy == "auto":
        strategy = "join" if any(s.predicate for s in steps) else "window"
    plan = {"window": _window_plan, "join": _join_plan}[strategy]
    return plan(elements, steps, id_col, affix_compat)

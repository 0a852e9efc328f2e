"""The filter algebra: a nested mapping compiled to one predicate, which Catalyst pushes down."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, SETS = ("id", "content", "media_type"), ("sources", "parents")
ALLOWED = {"text": {"eq", "ne", "in", "exists"}, "set": {"in", "exists", "contains"}, "ext": {"eq", "ne", "in", "lt", "lte", "gt", "gte", "exists", "contains"}}


def _check(op: str, value) -> None:
    items = value if op == "in" else [value]
    if op in ("eq", "ne", "in", "contains") and any(isinstance(x, float) for x in items):
        raise ValueError("identity over floating-point numbers is refused")
    if op in ("lt", "lte", "gt", "gte") and (isinstance(value, bool) or not isinstance(value, int | float)):
        raise ValueError("ordered comparison is for numbers only")


def predicate(node: Mapping, schema) -> Column:
    """The condition of a filter {op, field, value} or {op: and | or | not, clauses}; unfit shapes are refused.

    A missing path satisfies `ne`; a scalar under a path counts as a list of one; a list holds a value if any
    element equals it.
    """
    op = node["op"]
    if op in ("and", "or"):
        if len(node["clauses"]) < 2:
            raise ValueError(f"{op} needs two clauses or more")
        parts = [predicate(c, schema) for c in node["clauses"]]
        return reduce(lambda a, b: a & b if op == "and" else a | b, parts)
    if op == "not":
        if len(node["clauses"]) != 1:
            raise ValueError("not needs one clause")
        return ~predicate(node["clauses"][0], schema)
    field, value = node["field"].removeprefix("lineage.").removeprefix("ext."), node.get("value")
    kind = "text" if field in TEXT else "set" if field in SETS else "ext"
    if op not in ALLOWED[kind]:
        raise ValueError(f"{op} is not for {kind} fields")
    if op != "exists":
        _check(op, value)
    c = F.col(field)
    if kind == "text":
        return {"eq": lambda: F.coalesce(c == value, F.lit(False)), "ne": lambda: ~c.eqNullSafe(value), "in": lambda: F.coalesce(c.isin(list(value)), F.lit(False)), "exists": c.isNotNull}[op]()
    if kind == "set":
        return F.coalesce({"exists": lambda: F.size(c) > 0, "in": lambda: F.arrays_overlap(c, F.array(*map(F.lit, value))), "contains": lambda: F.array_contains(c, value)}[op](), F.lit(False))
    listed = schema[field.split(".")[0]].dataType.typeName() == "array" if "." not in field else False
    items = c if listed else F.array(c)
    holds = {
        "eq": lambda x: x == value, "contains": lambda x: x == value, "ne": lambda x: x == value, "in": lambda x: x.isin(list(value)) if isinstance(value, Sequence) else x == value,
        "lt": lambda x: x < value, "lte": lambda x: x <= value, "gt": lambda x: x > value, "gte": lambda x: x >= value,
    }
    if op == "exists":
        return F.coalesce(c.isNotNull() & (F.size(items) > 0), F.lit(False))
    found = F.coalesce(F.exists(items, holds[op]), F.lit(False))
    return ~found if op == "ne" else found


def matching(nodes: DataFrame, node: Mapping) -> DataFrame:
    """The nodes for which a filter holds."""
    return nodes.where(predicate(node, nodes.schema))


def visible(generations: Column, hidden: Sequence[str]) -> Column:
    """Whether a node shows: it is of no generation, or of one that is not hidden."""
    return (F.size(generations) == 0) | (F.size(F.array_except(generations, F.array(*map(F.lit, hidden)))) > 0)

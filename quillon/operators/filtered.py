"""Searches in which each question brings a filter of its own.

Filters are data. Those that differ in their values alone have one shape; the questions of a shape are asked in one
scan, whose pushed condition is the union of theirs, and each question's own condition is held against each node where
it is scored. So the number of scans is that of shapes, not of questions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import filters, search

#: Shapes that one call may hold, and values that a pushed list may have.
SHAPES, LISTED = 64, 10_000
_ORDER = {"lt": pc.less, "lte": pc.less_equal, "gt": pc.greater, "gte": pc.greater_equal}


def shape_of(node: Mapping | None) -> tuple[tuple, list]:
    """(shape, values): the filter with its values taken out, and these in order."""
    if node is None:
        return ("all",), []
    if node["op"] in ("and", "or", "not"):
        parts = [shape_of(c) for c in node["clauses"]]
        return (node["op"], *[s for s, _ in parts]), [v for _, values in parts for v in values]
    if node["op"] == "exists":
        return ("exists", node["field"]), []
    return (node["op"], node["field"]), [node["value"]]


def fields_of(shape: tuple) -> list[str]:
    """The fields of a shape, each once."""
    if shape[0] in ("and", "or", "not"):
        return list(dict.fromkeys(f for s in shape[1:] for f in fields_of(s)))
    return [] if shape[0] == "all" else [shape[1]]


def widened(shape: tuple, rows: list[list]) -> dict | None:
    """A filter that holds wherever that of any of these rows of values does; None where all nodes may."""

    def walk(s: tuple, at: int) -> tuple[dict | None, int]:
        op = s[0]
        if op in ("and", "or", "not"):
            parts = []
            for c in s[1:]:
                part, at = walk(c, at)
                parts.append(part)
            if op == "not" or op == "or" and None in parts:
                return None, at
            kept = [p for p in parts if p is not None]
            return (None if not kept else kept[0] if len(kept) == 1 else {"op": op, "clauses": kept}), at
        if op in ("all", "exists"):
            return ({"op": "exists", "field": s[1]} if op == "exists" else None), at
        values = [r[at] for r in rows]
        if op in ("eq", "in"):
            every = list(dict.fromkeys(v for x in values for v in (x if op == "in" else [x])))
            return ({"op": "in", "field": s[1], "value": every} if len(every) <= LISTED else None), at + 1
        if op in _ORDER:
            return {"op": op, "field": s[1], "value": (max if op[0] == "l" else min)(values)}, at + 1
        return None, at + 1

    return walk(shape, 0)[0]


def _any(column: pa.Array, test) -> np.ndarray:
    """Where a value, or any of a list's, passes; a null does not."""
    listed = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    told = pc.fill_null(test(column.flatten() if listed else column), False).to_numpy(zero_copy_only=False).astype(bool)
    if not listed:
        return told
    out = np.zeros(len(column), bool)
    np.logical_or.at(out, np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)), told)
    return out


def passing(shape: tuple, rows: list[list], columns: Mapping[str, pa.Array], size: int) -> np.ndarray:
    """By node and question whether the question's filter holds; the meaning is that of `filters.predicate`."""

    def walk(s: tuple, at: int) -> tuple[np.ndarray, int]:
        op = s[0]
        if op == "all":
            return np.ones((size, len(rows)), bool), at
        if op in ("and", "or", "not"):
            out = None
            for c in s[1:]:
                part, at = walk(c, at)
                out = part if out is None else out & part if op == "and" else out | part
            return (~out if op == "not" else out), at
        column = columns[s[1]]
        if op == "exists":
            there = column.is_valid().to_numpy(zero_copy_only=False)
            if pa.types.is_list(column.type):
                there = there & (pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) > 0)
            return np.repeat(there[:, None], len(rows), axis=1), at
        out = np.empty((size, len(rows)), bool)
        of: dict[str, list[int]] = {}
        for q, r in enumerate(rows):
            of.setdefault(json.dumps(r[at]), []).append(q)
        for asked in of.values():
            value = rows[asked[0]][at]
            if op in _ORDER:
                held = _any(column, lambda c: _ORDER[op](c, value))
            elif op == "in":
                held = _any(column, lambda c: pc.is_in(c, value_set=pa.array(value).cast(c.type)))
            else:
                held = _any(column, lambda c: pc.equal(c, pa.scalar(value).cast(c.type)))
            out[:, asked] = (~held if op == "ne" else held)[:, None]
        return out, at + 1

    return walk(shape, 0)[0]


def _questions(queries: DataFrame, schema) -> Iterator[tuple[tuple, list, np.ndarray, list[list]]]:
    """(shape, ids, unit vectors, values) of questions of one shape, as many together as a block holds."""
    held: dict[tuple, tuple[list, list, list]] = {}
    for r in queries.select("query_id", "vector", "filter").toLocalIterator():
        told = json.loads(r["filter"]) if r["filter"] is not None else None
        if told is not None:
            filters.predicate(told, schema)
        shape, values = shape_of(told)
        ids, vectors, rows = held.setdefault(shape, ([], [], []))
        if len(held) > SHAPES:
            raise ValueError(f"more than {SHAPES} shapes of filters")
        if vectors and (len(ids) == search.BLOCK or (len(ids) + 1) * len(r["vector"]) > search.CELLS):
            yield shape, ids, search._unit(np.array(vectors)), rows
            held[shape] = ids, vectors, rows = [], [], []
        ids.append(r["query_id"])
        vectors.append(np.array(r["vector"], float))
        rows.append(values)
    for shape, (ids, vectors, rows) in held.items():
        if ids:
            yield shape, ids, search._unit(np.array(vectors)), rows


def vector_top_k_each(queries: DataFrame, nodes: DataFrame, k: int = 20, where: Mapping | None = None) -> DataFrame:
    """(query_id, node_id, score, rank) by cosine, of the nodes that pass both the question's filter and the search's.

    queries: (query_id, vector, filter), the filter as JSON in the form of `filters.predicate`, null for none; nodes:
    (node_id, vector) and the fields that filters name. `where` narrows every question further; neither replaces the
    other. Filters that are unfit are refused before anything is read.
    """
    nodes = nodes.where(F.col("vector").isNotNull())
    if where is not None:
        nodes = filters.matching(nodes, where)
    out = None
    for shape, ids, asked, rows in _questions(queries, nodes.schema):
        fields = fields_of(shape)
        pushed = widened(shape, rows)
        scan = nodes if pushed is None else filters.matching(nodes, pushed)
        named = [F.col(f.removeprefix("lineage.").removeprefix("ext.")).alias(f"field_{i}") for i, f in enumerate(fields)]

        def score(what: tuple, batch: pa.RecordBatch, fields=tuple(fields)) -> np.ndarray:
            vectors, form, values = what
            columns = {f: batch.column(f"field_{i}") for i, f in enumerate(fields)}
            scores = np.round(search._unit(search._matrix(batch, vectors.shape[1])) @ vectors.T, 9)
            return np.where(passing(form, values, columns, batch.num_rows), scores, -np.inf)

        found = search._hits(scan.select("node_id", "vector", *named), queries, iter([(ids, (asked, shape, rows))]), score, k)
        out = found if out is None else out.union(found)
    return search._hits(nodes, queries, iter(()), None, k) if out is None else out

"""Ranks that look at where terms stand: cover density over postings with positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.operators import search

_SCHEMA = ("node_id", "length", "terms", "places")


def _placed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(node_id, length, terms, places) of a batch (node_id, lowered): distinct terms, and the places, from 1, where each stands."""
    words = [search._WORD.findall(x.as_py()) for x in batch.column("lowered")]
    length = np.fromiter(map(len, words), np.int64, len(words))
    every = pa.array([w for x in words for w in x], pa.string()).dictionary_encode()
    code = every.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(every) else np.empty(0, np.int64)
    node = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length) + 1
    order = np.lexsort((place, code, node))
    node, code, place = node[order], code[order], place[order]
    head = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (code[1:] != code[:-1])))) if len(node) else np.empty(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.append(head, len(node)).astype(np.int32)), pa.array(place))
    offsets = pa.array(np.searchsorted(node[head], np.arange(len(words) + 1)).astype(np.int32))
    terms = pa.ListArray.from_arrays(offsets, every.dictionary.take(pa.array(code[head])))
    return pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(length), terms, pa.ListArray.from_arrays(offsets, places)], names=list(_SCHEMA))


def positions(nodes: DataFrame) -> DataFrame:
    """(node_id, length, terms, places) of nodes (node_id, content); row-local. Store it where many questions are asked."""
    schema = T.StructType([nodes.schema["node_id"], T.StructField("length", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("places", T.ArrayType(T.ArrayType(T.LongType())))])
    return search._lowered(nodes).mapInArrow(lambda batches: map(_placed, search._pieces(batches)), schema)


def _occurrences(batch: pa.RecordBatch, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, term, place) of the batch's occurrences of the given terms, by node and place."""
    listed, places = batch.column("terms"), batch.column("places").flatten()
    node = np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
    which = pc.fill_null(pc.index_in(listed.flatten(), value_set=pa.array(terms, pa.string())), -1).to_numpy(zero_copy_only=False)
    size = pc.list_value_length(places).to_numpy(zero_copy_only=False)
    node, term, place = np.repeat(node, size), np.repeat(which, size), places.flatten().to_numpy(zero_copy_only=False)
    wanted = np.flatnonzero(term >= 0)
    order = wanted[np.lexsort((place[wanted], node[wanted]))]
    return node[order], term[order], place[order]


def covers(term: np.ndarray, place: np.ndarray, need: int) -> Iterator[tuple[int, int, int]]:
    """(first place, last place, occurrences within) of each least stretch that holds all `need` terms, in order.

    The right end moves on over the occurrences, ascending by place, until every term has been met; the least of the
    terms' latest places is then the left end, and a stretch is least if its left end is further right than that of
    the one before.
    """
    latest: dict[int, tuple[int, int]] = {}
    last = -1
    for k, (t, p) in enumerate(zip(term.tolist(), place.tolist())):
        latest[t] = (p, k)
        if len(latest) == need:
            left, begun = min(latest.values())
            if left > last:
                last = left
                yield left, p, k - begun + 1


def summed(stretches: Iterator[tuple[int, int, int]]) -> tuple[float, int, float]:
    """(sum of 0.1 over one more than the words between the terms, stretches, sum of one over the distances of their middles)."""
    total, count, apart, before = 0.0, 0, 0.0, None
    for first, last, terms in stretches:
        total += 0.1 / (1 + (last - first) - (terms - 1))
        middle = (first + last) / 2
        if before is not None and middle > before:
            apart += 1 / (middle - before)
        before, count = middle, count + 1
    return total, count, apart


def _normalised(total, count, apart, length, distinct, normalization: int) -> np.ndarray:
    if normalization & 1:
        total = total / np.log(length + 1)
    if normalization & 2:
        total = total / length
    if normalization & 4:
        total = np.where(apart > 0, total * apart / count, total)
    if normalization & 8:
        total = total / distinct
    if normalization & 16:
        total = total / np.log2(distinct + 1)
    if normalization & 32:
        total = total / (total + 1)
    return total


def cover_rank(queries: DataFrame, nodes: DataFrame, k: int = 20, *, every: bool = True, normalization: int = 0, index: DataFrame | None = None) -> DataFrame:
    """(query_id, node_id, score, rank) by cover density of the nodes that hold every term of a question, or any.

    Stretches of a node are the least ones that hold all terms of the question; with `every=False` each occurrence of
    a term is one. Each counts 0.1 over one more than the words in it that are no terms. normalization, a sum of: 1
    divides by ln(length + 1), 2 by the length, 4 by the harmonic mean of the distances between stretches, 8 by the
    distinct terms, 16 by log2(distinct terms + 1), 32 by itself plus one, in this order. Places are counted over the
    whole text, however long. Questions without a term and nodes without words give no hits.
    """
    if not 0 <= normalization < 64:
        raise ValueError("normalization is a sum of 1, 2, 4, 8, 16 and 32")
    source = search._lowered(nodes) if index is None else index

    def score(what: tuple, batch: pa.RecordBatch) -> np.ndarray:
        terms, has = what
        if "lowered" in batch.schema.names:
            batch = _placed(batch)
        node, term, place = _occurrences(batch, terms)
        length, distinct = (x.to_numpy(zero_copy_only=False) for x in (batch.column("length"), pc.list_value_length(batch.column("terms"))))
        scores = np.full((batch.num_rows, has.shape[1]), -np.inf)
        for q, need in enumerate(has.sum(axis=0).astype(int).tolist()):
            own = has[term, q] > 0
            n, t, p = node[own], term[own], place[own]
            if not every:
                first = np.concatenate(([True], n[1:] != n[:-1])) if len(n) else np.empty(0, bool)
                count = np.bincount(n, minlength=batch.num_rows)
                apart = np.bincount(n[1:], np.where(first[1:], 0, 1 / np.maximum(np.diff(p), 1)), batch.num_rows) if len(n) else count
                hit = np.flatnonzero(count)
                scores[hit, q] = np.round(_normalised(0.1 * count[hit], count[hit], apart[hit], length[hit], distinct[hit], normalization), 12)
                continue
            each = np.unique(n * len(terms) + t) // max(len(terms), 1)
            for x in np.flatnonzero((np.bincount(each, minlength=batch.num_rows) == need) & (need > 0)).tolist():
                at = slice(*np.searchsorted(n, (x, x + 1)))
                total, count, apart = summed(covers(t[at], p[at], need))
                scores[x, q] = np.round(_normalised(*(np.array([v], float) for v in (total, count, apart, length[x], distinct[x])), normalization), 12)[0]
        return scores

    return search._hits(source, queries, ((ids, search._asked(sets)) for ids, sets in search._term_blocks(queries)), score, k)

"""An index of vectors by trained cells, probed in rounds until enough nodes survive a filter.

Centres are fitted to a bounded sample; every node is then laid into the cell of its nearest centre, row by row, and the
table is stored in the order of cells, so that a probe reads the files' parts of its cells alone. A question looks
into its nearest cells first and into twice as many more each round, for as long as it has fewer than k hits that
pass the filter, or, where the answer must be exact, until no cell that is left can hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import search
from quillon.session import written

#: Cells at most; vectors of the sample for each; passes over the sample.
CELLS, EACH, PASSES = 4096, 64, 12


@dataclass
class Index:
    """table: (cell, node_id, vector, ...) in the order of cells; centres: unit rows; reach: least cosine of a cell's
    members to its centre; sizes: its members."""

    table: DataFrame
    centres: np.ndarray
    reach: np.ndarray
    sizes: np.ndarray


def centres_of(nodes: DataFrame, cells: int) -> np.ndarray:
    """Unit centres fitted to EACH vectors a cell, taken by a hash of their ids (all where there are fewer), by spherical means."""
    sample = nodes.where(F.col("vector").isNotNull()).select(F.xxhash64("node_id").alias("h"), "vector").orderBy("h").limit(cells * EACH)
    rows = [r["vector"] for r in sample.toLocalIterator()]
    if not rows:
        return np.empty((0, 0))
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors of more than one width")
    x = search._unit(np.array(rows, float))
    centres = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(PASSES):
        own = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        held = np.linalg.norm(total, axis=1) > 0
        centres[held] = search._unit(total[held])
    return centres


def build(nodes: DataFrame, cells: int | None = None) -> Index:
    """The index of all nodes (node_id, vector, ...) that have a vector; other columns stay, for filters.

    Without `cells` their number is the square root of the nodes', at most CELLS. A cell of very many nodes is split
    over files. Vectors of another width than the centres' are refused.
    """
    nodes = nodes.where(F.col("vector").isNotNull())
    if cells is None:
        cells = max(1, min(CELLS, int(nodes.count() ** 0.5)))
    centres = centres_of(nodes, cells)
    sent = nodes.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = search._unit(search._matrix(batch.select(["vector"]), sent.value.shape[1])) @ sent.value.T
            cell = np.argmax(near, axis=1) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(cell)), cell]), *batch.columns], names=["cell", "near", *batch.schema.names])

    if not len(centres):
        return Index(nodes.withColumn("cell", F.lit(0)), centres, np.empty(0), np.empty(0, np.int64))
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType()), *nodes.schema.fields])
    laid = nodes.mapInArrow(assign, schema).repartitionByRange("cell", "node_id").sortWithinPartitions("cell", "node_id")
    table = written(laid, "vector_index")
    reach, sizes = np.ones(len(centres)), np.zeros(len(centres), np.int64)
    for r in table.groupBy("cell").agg(F.min("near").alias("least"), F.count("*").alias("n")).toLocalIterator():
        reach[r["cell"]], sizes[r["cell"]] = r["least"], r["n"]
    return Index(table.drop("near"), centres, reach, sizes)


def _best_of(asked: np.ndarray, index: Index) -> np.ndarray:
    """By question and cell, the best cosine that a member can have: angles to the centre and of the cell's reach.

    A zero vector has cosine 0 with everything.
    """
    angle = np.arccos(np.clip(asked @ index.centres.T, -1, 1)) - np.arccos(np.clip(index.reach, -1, 1))
    best = np.cos(np.maximum(angle, 0)) + 1e-9
    best[np.linalg.norm(asked, axis=1) == 0] = 0
    best[:, index.sizes == 0] = -np.inf
    return best


def probed_top_k(index: Index, queries: DataFrame, k: int = 20, *, where: Column | str | None = None, first: int = 4, least: int = 0, exact: bool = False) -> tuple[DataFrame, list[dict]]:
    """((query_id, node_id, score, rank), report) of questions (query_id, vector): hits with their exact cosines.

    A question probes its `first` cells, then twice as many more each round, until it has looked into `least` cells
    and k of their nodes pass `where`, a predicate that is pushed into each round's scan; with `exact`, until no cell
    left can hold a node that belongs to its k best. No cell is scanned twice for a question, and a filter that few
    nodes pass costs rounds, never hits. The report has a row a round: questions, cells and rows that were read.
    Question ids are unique; no nodes and no questions give no hits.
    """
    out, report = None, []
    scan = index.table if where is None else index.table.where(where)

    def score(what: tuple, batch: pa.RecordBatch) -> np.ndarray:
        asked, looks = what
        x = search._unit(search._matrix(batch, asked.shape[1]))
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        scores = np.full((len(x), len(asked)), -np.inf)
        for cell in np.unique(cells):
            rows, columns = np.flatnonzero(cells == cell), np.flatnonzero(looks[:, cell])
            scores[np.ix_(rows, columns)] = np.round(x[rows] @ asked[columns].T, 9)
        return scores

    for ids, asked in search._vector_blocks(queries) if len(index.centres) else ():
        best = _best_of(asked, index)
        order = np.argsort(-(best if exact else np.where(index.sizes == 0, -np.inf, asked @ index.centres.T)), axis=1, kind="stable")
        number = int((index.sizes > 0).sum())
        place = {q: i for i, q in enumerate(ids)}
        at, width, active, hits = 0, first, np.ones(len(ids), bool), None
        while at < number and active.any():
            looks = np.zeros((len(ids), len(index.centres)), bool)
            rows = np.flatnonzero(active)
            looks[rows[:, None], order[rows, at : min(at + width, number)]] = True
            cells = np.flatnonzero(looks.any(axis=0))
            report.append({"round": len(report), "questions": int(active.sum()), "cells": len(cells), "rows": int(index.sizes[cells].sum())})
            found = search._hits(scan.where(F.col("cell").isin(cells.tolist())).select("node_id", "vector", "cell"), queries, iter([(ids, (asked, looks))]), score, k)
            hits = found if hits is None else written(search._top(hits.union(found).drop("rank"), k).select(found.columns), "probed")
            at, width = at + width, 2 * width
            told = {place[r["query_id"]]: (r["n"], r["kth"]) for r in hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).toLocalIterator()}
            for q in rows.tolist():
                n, kth = told.get(q, (0, -np.inf))
                done = n >= k and at >= least
                if exact and at < number:
                    done = n >= k and best[q, order[q, at]] < kth
                active[q] = not done
        if hits is not None:
            out = hits if out is None else out.union(hits)
    return (search._hits(index.table, queries, iter(()), score, k) if out is None else out), report

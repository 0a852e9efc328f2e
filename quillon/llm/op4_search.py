"""Exact top-k search by BM25: block-max WAND on an inverted index, shard by shard, merged on global statistics.

A shard lies in the order of its documents' likeness, so that the greatest scores of a block's terms are near those of
its documents. A query takes the blocks of a shard in the order of their bounds, some at a time; its k-th best score
rises with each turn, and blocks whose bound is below it (and the whole shard, where its terms' greatest scores are)
are not scored. It begins with what a part of the shards, searched ahead, gives over all of them. Blocks are scored in
single precision, and what may be among the k best in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.words import TERM_GAP, hashed, sliced, text_bytes
from quillon.session import table, written

K1, B = 1.2, 0.75
#: Tasks whose counts one group adds up; their sums are added up alike, level by level.
FAN = 64
#: Documents whose postings share a maximum, and the blocks that a query takes in its first turn in a shard.
BLOCK, FIRST = 64, 8
#: Documents of a shard, at most, queries that are scored together, and postings that these read at once, about.
SHARD, TOGETHER, POSTINGS = 5000, 512, 1 << 16
#: Terms that one of so many documents of a shard has are multiplied as a matrix: the most frequent, so many at most.
COMMON, MOST_COMMON = 32, 2048
#: One of so many shards is searched ahead; the k-th best of these is the least that counts in any shard.
AHEAD = 16
#: Query terms that are searched for in one pass over the index, about, and queries, at most.
PASS_TERMS, PASS_QUERIES = 1 << 22, 1 << 15
#: Most frequent terms of a shard by which its documents are put in order.
ORDERING_TERMS = 128
#: Decimals of a score; ranks go by the rounded score, then by id.
PLACES = 6
_ARRAYS = {"ids": np.int64, "lengths": np.int64, "terms": np.uint64, "starts": np.int64, "docs": np.int32, "counts": np.int32}


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return hashed(*text_bytes(column), lower=True, gap=TERM_GAP)


def _alike(doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """An order of n documents in which like ones are neighbours: halved again and again, at a block's border, along
    the direction in which they differ most in the shard's most frequent terms."""
    size = ends - starts
    common = np.lexsort((starts, -size))[:ORDERING_TERMS]
    x = np.zeros((n, len(common)), np.float32)
    for j, t in enumerate(common.tolist()):
        x[doc[starts[t] : ends[t]], j] = 1
    order = np.arange(n)
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= BLOCK:
            continue
        own = x[order[a:b]]
        own = own - own.mean(axis=0)
        v = np.linspace(1, 2, own.shape[1], dtype=np.float32)
        for _ in range(8):
            v = own.T @ (own @ v)
            v /= max(float(np.linalg.norm(v)), 1e-30)
        order[a:b] = order[a:b][np.argsort(own @ v, kind="stable")]
        middle = a + max(1, (b - a) // 2 // BLOCK) * BLOCK
        todo += [(a, middle), (middle, b)]
    return order


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: a row a shard (at most SHARD documents), with its postings by term and document.

    Terms are runs of ASCII letters (A-Z folded), digits, low lines and all characters beyond ASCII. Every row is
    indexed, repeated rows each by itself, null texts as documents without terms.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SHARD):
            h, first = _terms(batch.column("text"))
            lengths = np.diff(first)
            doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.empty(0, np.int64)
            counts = np.diff(np.append(head, len(h)))
            h, doc = h[head], doc[head]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            if len(h) and len(ids) > BLOCK:
                order = _alike(doc, starts, np.append(starts[1:], len(h)), len(ids))
                place = np.empty(len(ids), np.int32)
                place[order] = np.arange(len(ids), dtype=np.int32)
                doc = place[doc]
                again = np.lexsort((doc, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))))
                doc, counts, ids, lengths = doc[again], counts[again], ids[order], lengths[order]
            arrays = {"ids": ids, "lengths": lengths, "terms": h[starts], "starts": np.append(starts, len(h)), "docs": doc, "counts": counts}
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(arrays[k], t).tobytes()], pa.binary()) for k, t in _ARRAYS.items()], names=list(_ARRAYS))

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return columns.mapInArrow(build, ", ".join(f"{k} binary" for k in _ARRAYS))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in _ARRAYS.items()}


def _cuts(values: np.ndarray) -> list[int]:
    """Where runs of equal values begin, and their end."""
    return [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)] if len(values) else [0]


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Shard:
    """A shard's postings with their scores under given global statistics, and the greatest of every (common term, block).

    `idf` has the wanted terms' weights; all other postings count nothing. Common terms are columns of a matrix that is
    multiplied block by block, the others lists that are added up for all queries of a batch together.
    """

    def __init__(self, arrays: dict[str, np.ndarray], mean: float, at: np.ndarray, idf: np.ndarray) -> None:
        self.ids, self.starts, self.docs = (arrays[k] for k in ("ids", "starts", "docs"))
        n, many = len(self.ids), np.diff(self.starts)
        tf = arrays["counts"].astype(float)
        weight = np.zeros(len(many))
        weight[at] = idf
        self.scores = np.repeat(weight, many) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * arrays["lengths"] / mean)[self.docs])
        self.term_most = np.maximum.reduceat(self.scores, self.starts[:-1]) if len(self.docs) else np.empty(0)
        self.blocks = -(-n // BLOCK)
        common = np.flatnonzero((many * COMMON >= n) & (weight > 0))
        if len(common) > MOST_COMMON:
            common = np.sort(common[np.argsort(-many[common], kind="stable")[:MOST_COMMON]])
        self.column = np.full(len(many), -1)
        self.column[common] = np.arange(len(common))
        near = _spread(self.starts[common], self.starts[common + 1])
        self.exact = np.zeros((self.blocks * BLOCK, len(common)))
        self.exact[self.docs[near], np.repeat(np.arange(len(common)), many[common])] = self.scores[near]
        self.dense = self.exact.astype(np.float32)
        self.dense_most = np.ascontiguousarray(self.dense.reshape(self.blocks, BLOCK, len(common)).max(axis=1).T)
        #: By what share a sum of so many single-precision numbers, none below zero, may be off, twice over.
        self.off = 2.0**-22 * (len(common) + 4)
        #: Blocks that were scored for some query, and those that a query has terms in.
        self.scored = self.there = 0

    def rare(self, who: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Of n queries (`who` ascends) what the given terms add to the score of each document."""
        width = self.blocks * BLOCK
        out = np.zeros((n, width))
        start, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        upto = np.concatenate(([0], np.cumsum(np.bincount(who, size, n)))).astype(np.int64)
        first = np.searchsorted(who, np.arange(n + 1))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + POSTINGS, "right")) - 1)
            own = slice(first[a], first[b])
            near = _spread(start[own], start[own] + size[own])
            if len(near):
                out[a:b] = np.bincount(np.repeat((who[own] - a) * width, size[own]) + self.docs[near], self.scores[near], (b - a) * width).reshape(b - a, width)
            a = b
        return out

    def search(self, queries: list[np.ndarray], held: list[list[tuple[float, int]]], k: int, floor: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """For each query (places of its terms) the k best of those held and of this shard, as (-score, id).

        `floor` has scores that the k-th best reaches in any case; what is below may be left out.
        """
        n = len(queries)
        least = np.array([-h[-1][0] if len(h) == k else 0.0 for h in held])
        least = least if floor is None else np.maximum(least, floor)
        who, terms = np.repeat(np.arange(n), [len(q) for q in queries]), np.concatenate(queries)
        alive = np.bincount(who, self.term_most[terms], n) >= least - 2 * 10.0**-PLACES
        who, terms = who[alive[who]], terms[alive[who]]
        column = self.column[terms]
        common = column >= 0
        asked = np.zeros((n, len(self.dense_most)), np.float32)
        asked[who[common], column[common]] = 1
        scores = self.rare(who[~common], terms[~common], n).reshape(n, self.blocks, BLOCK)
        bound = (asked @ self.dense_most + scores.max(axis=2)) * (1 + self.off)
        self.there += int((bound > 0).sum())
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        out = list(held)
        at, step = 0, FIRST
        while at < self.blocks:
            who, turn = np.nonzero((bound[:, at : at + step] > 0) & (bound[:, at : at + step] >= least[:, None] - 2 * 10.0**-PLACES))
            if not len(who):
                break
            block = order[who, at + turn]
            self.scored += len(who)
            about = scores[who, block]
            by = np.argsort(block, kind="stable")
            cut = _cuts(block[by])
            for a, b in zip(cut, cut[1:]):
                first = block[by[a]] * BLOCK
                about[by[a:b]] += asked[who[by[a:b]]] @ self.dense[first : first + BLOCK].T
            need = least.copy()
            cut = _cuts(who)
            for a, b in zip(cut, cut[1:]):
                if need[who[a]] == 0:
                    need[who[a]] = np.partition(about[a:b].ravel(), -k)[-k] if (b - a) * BLOCK >= k else 0
            pair, place = np.nonzero(about >= np.maximum(need * (1 - self.off) ** 2 - 2 * 10.0**-PLACES, 10.0**-12)[who][:, None])
            query, doc = who[pair], block[pair] * BLOCK + place
            score = scores[query, block[pair], place]
            for a in range(0, len(query), 1024):
                score[a : a + 1024] += (self.exact[doc[a : a + 1024]] * asked[query[a : a + 1024]]).sum(axis=1)
            score = np.round(score, PLACES)
            query, doc, score = query[score > 0], doc[score > 0], score[score > 0]
            ids, score, cut = self.ids[doc].tolist(), (-score).tolist(), _cuts(query)
            for a, b in zip(cut, cut[1:]):
                i = int(query[a])
                out[i] = sorted(out[i] + list(zip(score[a:b], ids[a:b])))[:k]
                if len(out[i]) == k:
                    least[i] = max(least[i], -out[i][-1][0])
            at, step = at + step, 2 * step
        return out

    def best(self, scores: np.ndarray, k: int, least: float) -> list[tuple[float, int]]:
        """(-score, id) of the k best that reach `least`, rounded; ties by id."""
        near = np.flatnonzero(scores >= max(least - 2 * 10.0**-PLACES, 10.0**-12))
        if len(near) > k:
            near = near[scores[near] >= np.partition(scores[near], -k)[-k] - 2 * 10.0**-PLACES]
        score = np.round(scores[near], PLACES)
        near, score = near[score > 0], score[score > 0]
        top = np.lexsort((self.ids[near], -score))[:k]
        return list(zip((-score[top]).tolist(), self.ids[near[top]].tolist()))


def _passes(queries: DataFrame, most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(ids, distinct terms) of the queries, so many together as have about `most` terms."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = _terms(batch.column("text"))
            terms = [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(terms, pa.binary())], names=["query_id", "terms"])

    ids: list[int] = []
    terms: list[np.ndarray] = []
    held = 0
    for r in written(queries.mapInArrow(parse, "query_id long, terms binary"), "queries").toLocalIterator():
        ids.append(r["query_id"])
        terms.append(np.frombuffer(r["terms"], np.uint64))
        held += len(terms[-1])
        if held >= most or len(ids) == PASS_QUERIES:
            yield ids, terms
            ids, terms, held = [], [], 0
    if ids:
        yield ids, terms


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, indexed: DataFrame, k: int, *, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents of positive score that score highest, exactly.

    queries has (query_id, text); each distinct term of the whole text counts once. Score: the sum over terms of
    ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean length)), rounded to
    six places; equal scores rank by id. Queries are taken in passes of bounded size, each a scan of the index
    that counts df over all shards, one over a part of the shards, whose k-th best of a query is the least that can
    count, and one that keeps each task's k best that reach it: the sum of a block's term maxima bounds its documents,
    and blocks (or whole shards) below the k-th score so far are not scored. A query that is null, empty
    or matches nothing has no rows; repeated queries have theirs once each by id; a null document id shows as -1.
    """
    spark = indexed.sparkSession
    sizes = indexed.select((F.octet_length("ids") / 8).cast("long").alias("n"), "lengths")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [int(np.frombuffer(x.as_buffer(), np.int64).sum()) for x in batch.column("lengths")]
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(lengths, pa.int64())], names=["n", "total"])

    n, total = sizes.mapInArrow(measure, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    mean = max(total, 1) / max(n, 1)
    out = None
    for ids, terms in _passes(queries, pass_terms):
        wanted = np.unique(np.concatenate(terms)) if terms else np.empty(0, np.uint64)
        sent = spark.sparkContext.broadcast(wanted)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(sent.value), np.int64)
            for s in _shards(batches):
                at = np.minimum(np.searchsorted(s["terms"], sent.value), max(0, len(s["terms"]) - 1))
                if len(s["terms"]):
                    df += np.where(s["terms"][at] == sent.value, np.diff(s["starts"])[at], 0)
            task = TaskContext.get().partitionId()
            for a in range(0, len(df), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([task], pa.int64()), pa.array([df[a : a + (1 << 16)].tobytes()], pa.binary())], names=["part", "task", "df"])

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"part": t.column("part").slice(0, 1), "task": pa.array([t.column("task")[0].as_py() // FAN], pa.int64()), "df": pa.array([np.sum([np.frombuffer(x, np.int64) for x in t.column("df").to_pylist()], axis=0).tobytes()], pa.binary())})

        df = np.zeros(len(wanted), np.int64)
        counted = indexed.select("terms", "starts", *[F.lit(b"").alias(x) for x in ("ids", "lengths", "docs", "counts")]).mapInArrow(count, "part long, task long, df binary")
        tasks = indexed.rdd.getNumPartitions()
        while tasks:
            counted = counted.groupBy("part", F.floor(F.col("task") / FAN).alias("to")).applyInArrow(add, "part long, task long, df binary")
            tasks = (tasks - 1) // FAN
        for r in counted.toLocalIterator():
            part = np.frombuffer(r["df"], np.int64)
            df[r["part"] : r["part"] + len(part)] += part
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        places = [np.searchsorted(wanted, t).astype(np.int32) for t in terms]
        asked = spark.sparkContext.broadcast((ids, places, wanted, idf))

        def best(batches: Iterator[pa.RecordBatch], floors=None, asked=asked) -> Iterator[pa.RecordBatch]:
            ids, places, wanted, idf = asked.value
            floor = np.zeros(len(ids)) if floors is None else floors.value
            held: list[list[tuple[float, int]]] = [[] for _ in ids]
            for arrays in _shards(batches):
                if not len(arrays["terms"]):
                    continue
                at = np.minimum(np.searchsorted(arrays["terms"], wanted), len(arrays["terms"]) - 1)
                there = arrays["terms"][at] == wanted
                s = _Shard(arrays, mean, at[there], idf[there])
                here = [(i, at[p[there[p]]]) for i, p in enumerate(places)]
                here = [(i, found) for i, found in here if len(found)]
                for a in range(0, len(here), TOGETHER):
                    who = [i for i, _ in here[a : a + TOGETHER]]
                    for i, hits in zip(who, s.search([found for _, found in here[a : a + TOGETHER]], [held[i] for i in who], k, floor[who])):
                        held[i] = hits
            rows = [(query_id, doc_id, -score) for query_id, h in zip(ids, held) for score, doc_id in h]
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000]), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "doc_id", "score"])

        hits = "query_id long, doc_id long, score double"
        ahead = _ranked(indexed.where(F.crc32("ids") % AHEAD == 0).mapInArrow(best, hits), k).where(F.col("rank") == k)
        reached = {r["query_id"]: r["score"] for r in ahead.select("query_id", "score").toLocalIterator()}
        floors = spark.sparkContext.broadcast(np.array([reached.get(i, 0.0) for i in ids]))
        found = written(indexed.mapInArrow(partial(best, floors=floors), hits), "hits")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    return _ranked(out, k).select("query_id", "rank", "doc_id", "score")


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents closest to every hundredth document's whole text, over all documents."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(queries, written(index(docs), "index"), 10)


OP4_SQL = r"""
WITH t AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z_\x{80}-\x{10FFFF}]+')) AS term
    FROM documents
), tf AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
len AS (SELECT doc_id, sum(n) AS size FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
g AS (SELECT count(*) AS docs, (SELECT sum(size) FROM len) / count(*) AS mean FROM documents),
q AS (SELECT doc_id AS query_id, term FROM tf WHERE doc_id % 100 = 0),
s AS (
    SELECT q.query_id, tf.doc_id,
        round(sum(ln(1 + (g.docs - df.df + 0.5) / (df.df + 0.5)) * tf.n * 2.2 / (tf.n + 1.2 * (0.25 + 0.75 * len.size / g.mean))), 6) AS score
    FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.doc_id = tf.doc_id CROSS JOIN g
    GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""

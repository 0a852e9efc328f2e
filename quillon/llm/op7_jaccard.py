"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.words import hashed, mixed, runs, text_bytes, unused
from quillon.session import table, written

#: Fixed sizes, whatever the corpus: bits that tell shingles of more than one class (16 MB), cells that tell how
#: frequent the frequent ones are (4 MB), bits that tell candidate classes (8 MB). A crowded filter costs
#: candidates or bytes, never a link.
SHARED_BITS, COMMON_BITS, FILTER_BITS = 27, 22, 26
#: From how many occurrences a shingle has its frequency kept.
COMMON = 8
#: Most matches that a document may ask for, and the cost of a verification in units of a posting.
MOST, VERIFY = 4, 20.0
#: Longer lists of a shingle are joined by way of leaders.
LONG = 16
#: Members of a long list that a block of its pairs holds on one side, about.
BLOCK = 1000
#: Tasks that the members of one list are dealt over where each is held against one row; a long list has LONG members
#: at least, so that row is sent no oftener than half of these.
DEAL = 8
_POST = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<i4"), ("own", "<i4"), ("pos", "<i4"), ("ask", "<i4")])
_SEEN = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("cls", "<i8"), ("n", "<i8")])


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z folded, `size` words, or all where a text has fewer."""
    h, first = hashed(*text_bytes(column), lower=True)
    every = runs(h, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(every[a : b - size + 1]) if b - a >= size else runs(h[a:b], b - a) if b > a else every[:0]


def class_of(s: np.ndarray) -> int:
    """A set's identity: 63 bits of a hash of its members' sum and number (0: the empty set)."""
    return int(mixed(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0] >> np.uint64(1)) | 1 if len(s) else 0


def _counted(texts: DataFrame, shingle: int, shards: int) -> tuple[bytes, bytes]:
    """(bitmap of the shingles that occur more than once, log2 of the frequency of common ones), by leading bits.

    Every shingle of every batch's distinct sets is counted exactly but for its trailing bits: 32 and as many as
    number the shards are kept, and a shard is a range of them. Bits are set for too many shingles, never too few.
    """
    width = 32 + max(0, shards.bit_length() - 1)
    edges = [-(-(k << width) // shards) for k in range(shards + 1)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct = {class_of(s): s for s in shingle_sets(batch.column("text"), shingle)}
            tokens = np.concatenate(list(distinct.values())) if distinct else np.empty(0, np.uint64)
            values, n = np.unique(tokens >> np.uint64(64 - width), return_counts=True)
            cut = [0, *np.searchsorted(values, np.array(edges[1:-1], np.uint64)).tolist(), len(values)]
            rows = []
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                if a < b:
                    v, m = (values[a:b] - np.uint64(edges[k])).astype(np.uint32), n[a:b]
                    rows.append((k, v[m == 1].tobytes(), v[m > 1].tobytes(), m[m > 1].astype(np.uint32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "once", "more", "times"])

    def add(t: pa.Table) -> pa.Table:
        k = t.column("shard")[0].as_py()
        once, more, times = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32) for c in ("once", "more", "times"))
        values, back = np.unique(np.concatenate((once, more)), return_inverse=True)
        n = np.bincount(back, np.concatenate((np.ones(len(once)), times)), len(values))
        values, n = values[n > 1].astype(np.uint64) + np.uint64(edges[k]), n[n > 1]
        at = (values >> np.uint64(width - SHARED_BITS)).astype(np.int64)
        first = edges[k] >> (width - SHARED_BITS + 3) << 3
        bits = np.zeros((edges[k + 1] - 1 >> (width - SHARED_BITS)) - first + 1, bool)
        bits[at - first] = True
        low = edges[k] >> (width - COMMON_BITS)
        cells = np.zeros((edges[k + 1] - 1 >> (width - COMMON_BITS)) - low + 1, np.uint8)
        common = n >= COMMON
        np.maximum.at(cells, (values[common] >> np.uint64(width - COMMON_BITS)).astype(np.int64) - low, np.log2(n[common]).astype(np.uint8))
        return pa.table({"first": [first], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "low": [low], "cells": pa.array([cells.tobytes()], pa.binary())})

    shared, common = np.zeros(1 << SHARED_BITS - 3, np.uint8), np.zeros(1 << COMMON_BITS, np.uint8)
    counted = texts.select("text").mapInArrow(send, "shard int, once binary, more binary, times binary")
    for r in counted.groupBy("shard").applyInArrow(add, "first long, bits binary, low long, cells binary").toLocalIterator():
        bits, cells = np.frombuffer(r["bits"], np.uint8), np.frombuffer(r["cells"], np.uint8)
        at = slice(r["first"] >> 3, (r["first"] >> 3) + len(bits))
        shared[at] |= bits
        at = slice(r["low"], r["low"] + len(cells))
        common[at] = np.maximum(common[at], cells)
    return shared.tobytes(), common.tobytes()


def prefix(s: np.ndarray, shared: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(shared tokens of a set's prefix, their places, how many a partner must share, how many tokens are its own).

    All sets order their tokens alike: those of one class only, then the others, the rarest first. Two sets as
    similar as asked, each with its first n - ceil(percent * n / 100) + k tokens in that order, share k of these
    (the k-th of o common tokens has at least o - k after it in either set; a pair's sizes bound o more closely).
    A longer prefix reads more postings (the sum of the tokens' frequencies) but leaves at most that sum over k
    candidates: k is chosen for the least estimated cost. A set whose own tokens are too many has no partner.
    """
    n = len(s)
    bit = (s >> np.uint64(64 - SHARED_BITS)).astype(np.int64)
    met = (shared[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
    own, least = n - int(met.sum()), -(-percent * n // 100)
    if n - own < least:
        return s[:0], np.empty(0, np.int64), 1, own
    rank = np.where(met, 1 + common[(s >> np.uint64(64 - COMMON_BITS)).astype(np.int64)].astype(np.int64), 0)
    order = np.lexsort((s, rank))
    most = max(1, min(MOST, least))
    seen = np.where(rank == 0, 0, np.where(rank == 1, 2, 1 << np.minimum(rank - 1, 40)))[order]
    cost = np.cumsum(seen[: n - least + most])[n - least :].astype(float)
    ask = 1 + int(np.argmin(cost[:most] * (1 + VERIFY / np.arange(1, most + 1))))
    return s[order[own : n - least + ask]], np.arange(own, n - least + ask), ask, own


def _postings(texts: DataFrame, filters, shingle: int, percent: int, shards: int) -> DataFrame:
    """Shared postings of each batch's distinct sets, packed by shards of the token; with them, what each row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, common = (np.frombuffer(x, np.uint8) for x in filters.value)
        for turn, batch in enumerate(batches):
            ids = batch.column("doc_id")
            rows = np.zeros(batch.num_rows, _SEEN)
            rows["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
            rows["doc_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            seen: set[int] = {0}
            parts = [np.empty(0, _POST)]
            for i, s in enumerate(shingle_sets(batch.column("text"), shingle)):
                cls = class_of(s)
                rows["cls"][i], rows["n"][i] = cls, len(s)
                if cls in seen:
                    continue
                seen.add(cls)
                tokens, places, ask, own = prefix(s, shared, common, percent)
                if len(tokens):
                    p = np.empty(len(tokens), _POST)
                    p["token"], p["cls"], p["n"], p["own"], p["pos"], p["ask"] = tokens, cls, len(s), own, places, ask
                    parts.append(p)
            posts = np.concatenate(parts)
            shard = ((posts["token"] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            order = np.argsort(shard, kind="stable")
            posts, shard = posts[order], shard[order]
            cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(posts)] if len(posts) else []
            at = shard[cut[:-1]].astype(np.int64).tolist() if cut else []
            out = [(k, posts[a:b].tobytes(), None) for k, a, b in zip(at, cut, cut[1:])]
            out += [(int(rows["cls"][a]) % shards, None, rows[a : a + 500].tobytes()) for a in range(0, len(rows), 500)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["shard", "posts", "rows"])

    return texts.mapInArrow(run, "shard int, posts binary, rows binary")


def _may(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether postings of one token can belong to a pair: by sizes, by tokens that are not a set's own, by the
    places that a pair's first matches can have, and by what can still match after, and have matched before, these."""
    nx, ny, i, j, ux, uy = (v.astype(np.int64) for v in (x["n"], y["n"], x["pos"], y["pos"], x["own"], y["own"]))
    ask = np.minimum(x["ask"], y["ask"])
    keep = np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * percent
    need = -(-percent * (nx + ny) // (100 + percent))
    keep &= (i < nx + ask - need) & (j < ny + ask - need)
    return keep & (np.minimum(i - ux, j - uy) + np.minimum(nx - i, ny - j) >= need)


_LISTED = pa.schema([(n, pa.int64()) for n in ("a", "b", "token", "doc_id", "cls")] + [(n, pa.int32()) for n in ("ask", "matches", "n", "own", "pos")])


def _listed(postings: DataFrame, percent: int) -> DataFrame:
    """Three kinds of rows: pairs (a, b, ask, matches) of short lists, summed by shard; the postings (token, cls, n,
    own, pos, ask) of long lists; and the documents (doc_id, cls, n), token and pair being null."""

    def table_of(size: int, **columns) -> pa.Table:
        return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _LISTED], schema=_LISTED)

    def join(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(x for x in t.column("rows").to_pylist() if x), _SEEN)
        ids = pa.array(rows["doc_id"], mask=rows["known"] == 0)
        out = [table_of(len(rows), doc_id=ids, cls=rows["cls"], n=rows["n"].astype(np.int32))]
        p = np.frombuffer(b"".join(x for x in t.column("posts").to_pylist() if x), _POST)
        if len(p):
            p = p[np.lexsort((p["cls"], p["token"]))]
            p = p[np.concatenate(([True], (p["token"][1:] != p["token"][:-1]) | (p["cls"][1:] != p["cls"][:-1])))]
            head = np.flatnonzero(np.concatenate(([True], p["token"][1:] != p["token"][:-1])))
            count = np.diff(np.append(head, len(p)))
            size = np.repeat(count, count)
            long, short = p[size >= LONG], p[(size > 1) & (size < LONG)]
            out.append(table_of(len(long), token=long["token"].view(np.int64) if long["token"].flags.c_contiguous else long["token"].astype(np.int64), **{k: long[k] for k in ("cls", "n", "own", "pos", "ask")}))
            pairs = [np.empty((3, 0), np.int64)]
            for d in range(1, LONG - 1):
                x, y = short[:-d], short[d:]
                same = x["token"] == y["token"]
                if not same.any():
                    break
                x, y = x[same], y[same]
                keep = _may(x, y, percent)
                pairs.append(np.stack((x["cls"][keep], y["cls"][keep], np.minimum(x["ask"], y["ask"])[keep].astype(np.int64))))
            a, b, ask = np.concatenate(pairs, axis=1)
            order = np.lexsort((b, a))
            a, b, ask = a[order], b[order], ask[order]
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
            out.append(table_of(len(first), a=a[first], b=b[first], ask=ask[first].astype(np.int32), matches=np.diff(np.append(first, len(a))).astype(np.int32)))
        return pa.concat_tables(out)

    return postings.groupBy("shard").applyInArrow(join, "a long, b long, token long, doc_id long, cls long, ask int, matches int, n int, own int, pos int")


def _bitmap(values: DataFrame) -> bytes:
    """Bits set at the leading bits of the 63-bit numbers of column `cls`; each task sets those of its own range."""
    spot = F.shiftright("cls", 63 - FILTER_BITS)

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"spots": pa.array([np.unique(t.column("spot").to_numpy()).astype(np.uint32).tobytes()], pa.binary())})

    bits = np.zeros(1 << FILTER_BITS, bool)
    spots = values.select(spot.cast("int").alias("spot")).distinct().groupBy(F.shiftright("spot", FILTER_BITS - 8).alias("part")).applyInArrow(pack, "spots binary")
    for r in spots.toLocalIterator():
        bits[np.frombuffer(r["spots"], np.uint32)] = True
    return np.packbits(bits).tobytes()


def _sets(docs: DataFrame, wanted, shingle: int) -> DataFrame:
    """(cls, tokens) of the classes in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            found = {}
            for s in shingle_sets(batch.column("text"), shingle):
                cls = class_of(s)
                spot = cls >> (63 - FILTER_BITS)
                if cls and bits[spot >> 3] >> (7 - (spot & 7)) & 1:
                    found[cls] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["cls", "tokens"])

    return docs.mapInArrow(run, "cls long, tokens binary").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar indeed, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                same = int((q[at] == p).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    with_b = pairs.select("a", "b").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("of_b")), "b")
    return with_b.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("of_a")), "a").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _fits(x: str, y: str, percent: int):
    """`_may` as a condition on the columns of two joined tables."""
    text = f"""least({x}.n, {y}.n) * 100L >= greatest({x}.n, {y}.n) * {percent}L
        AND {x}.pos < {x}.n + least({x}.ask, {y}.ask) - ceil({percent} * ({x}.n + {y}.n) / {100 + percent}.0)
        AND {y}.pos < {y}.n + least({x}.ask, {y}.ask) - ceil({percent} * ({x}.n + {y}.n) / {100 + percent}.0)
        AND least({x}.pos - {x}.own, {y}.pos - {y}.own) + least({x}.n - {x}.pos, {y}.n - {y}.pos) >= ceil({percent} * ({x}.n + {y}.n) / {100 + percent}.0)"""
    return F.expr(text)


def _enough(pairs: DataFrame) -> DataFrame:
    """The pairs that meet as often as they ask for."""
    return pairs.groupBy("a", "b").agg(F.sum("matches").alias("matches"), F.max("ask").alias("ask")).where("matches >= ask")


def _dealt(members: DataFrame, of_token: DataFrame) -> DataFrame:
    """members joined with what there is one row of for each token; a token's members are dealt over DEAL tasks."""
    salted = members.withColumn("deal", F.pmod(F.xxhash64("cls"), F.lit(DEAL)).cast("int"))
    return salted.join(of_token.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))), ["token", "deal"]).drop("deal")


def _connecting(short: DataFrame, long: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) that connect what all links connect: long lists by way of their leaders."""
    leaders = long.groupBy("token").agg(F.min(F.struct("own", "pos", "cls", "n")).alias("lead"))
    to_leader = _dealt(long, leaders).where(
        f"""cls <> lead.cls and least(n, lead.n) * 100L >= greatest(n, lead.n) * {percent}L
        and least(n - own, lead.n - lead.own) >= ceil({percent} * (n + lead.n) / {100 + percent}.0)"""
    )
    stars = written(_verified(to_leader.select(F.col("cls").alias("a"), F.col("lead.cls").alias("b")).distinct(), sets, percent), "stars")
    group = components(stars).select(F.col("node").alias("cls"), F.col("label").alias("lead"))
    grouped = long.join(group, "cls", "left").withColumn("lead", F.coalesce("lead", "cls"))
    grouped = written(grouped, "grouped")
    most = grouped.groupBy("token", "lead").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "lead")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    inside = _dealt(grouped, most.select("token", F.col("most.lead").alias("most")))
    apart = inside.where("lead <> most").alias("x").join(inside.alias("y"), F.expr("x.token = y.token and x.lead <> y.lead and (y.lead = y.most or x.cls < y.cls)") & _fits("x", "y", percent))
    crossed = apart.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"), F.least("x.ask", "y.ask").alias("ask"), F.lit(1).alias("matches"))
    return _verified(_enough(short.union(crossed)), sets, percent).union(stars)


def _paired(long: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ask, matches) of all members of long lists; a list is joined in as many salted blocks as it needs."""
    blocks = long.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = long.join(blocks, "token")
    x = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = members.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).alias("y")
    met = x.join(y, F.expr("x.token = y.token and x.block = y.block and x.cls < y.cls") & _fits("x", "y", percent))
    return met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.least("x.ask", "y.ask").alias("ask"), F.lit(1).alias("matches"))


def _links_of(measured: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, n_links): how many other documents each document of a class is linked with, its equals included."""
    sizes = measured.where("cls <> 0").groupBy("cls").agg(F.count("*").alias("size"))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, both["b"] == sizes["cls"]).groupBy("a").agg(F.sum("size").alias("others"))
    return sizes.join(others, sizes["cls"] == others["a"], "left").select("cls", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, per_shard: int = 2000, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, cls, n_links, component_id) of every document: all links of `percent` or more, and their components.

    n_links is the number of other rows that a document is linked with: verified pairs of classes, weighted by the
    classes' sizes. For it all members of a long list are paired, and what is verified grows with the number of
    links, in a group of near copies with the square of its size. Without `count_links` the column is left out,
    only the links that components need are formed, and no group costs its square.

    Equal sets are one class (63-bit identity), so copies cost a row each and no pairs. Classes meet in the lists
    of their prefixes' shingles. Short lists give their pairs. Without `count_links`, in a long list each member is first held against
    the list's leader (the set with the fewest tokens of its own); members that these links connect need no pair
    between them, and only those outside the list's largest group are joined with the rest. All pairs with enough matches
    are verified on whole sets, so no link between two components is lost.

    Texts that are null or without words are linked with nothing. Repeated rows are one class; a null id is kept
    and, where it is in a component, not its name. Other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = max(16, docs.count() // per_shard)
    filters = spark.sparkContext.broadcast(_counted(texts, shingle, shards))
    listed = written(_listed(_postings(texts, filters, shingle, percent, shards), percent), "lists")
    measured = listed.where("a is null and token is null").select("doc_id", "cls", F.col("n").cast("long").alias("n"))
    short = listed.where("a is not null").select("a", "b", "ask", "matches")
    long = listed.where("token is not null").select("cls", "token", "n", "own", "pos", "ask")
    wanted = short.select(F.col("a").alias("cls")).union(short.select("b")).union(long.select("cls")).distinct()
    sets = written(_sets(texts.select("text"), spark.sparkContext.broadcast(_bitmap(wanted)), shingle), "candidates")

    if count_links:
        pairs = short.union(_paired(long, percent).select("a", "b", "ask", "matches"))
        links = written(_verified(_enough(pairs), sets, percent), "all_links")
    else:
        links = _connecting(short, long, sets, percent)
    labels = components(links)
    classes = measured.groupBy("cls").agg(F.min("doc_id").alias("low")).join(labels, F.col("cls") == F.col("node"), "left").select("cls", "low", F.coalesce("label", "cls").alias("label"))
    lowest = classes.where("cls <> 0").groupBy("label").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "label", "left").select("cls", "component_id")
    if count_links:
        named = named.join(_links_of(measured, links), "cls", "left")
    counted = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return measured.join(named, "cls").select("doc_id", F.col("n").alias("n_shingles"), "cls", *counted, F.when(F.col("cls") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles counted, and its component of near copies named."""
    return join(table(spark, sf_dir, "documents"), count_links=False).drop("cls")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies (five words, 0.8 or more) one document stays.

    It is the component's first row in the order in which the rows are numbered, which is written before it is used, so
    a later scan in other splits changes nothing; of repeated rows one stays too. Documents
    that are null or without words are linked with nothing and all stay. Columns are those of docs.
    """
    row = unused("row", docs)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = join(numbered, id_col=row, shingle=5, percent=80, count_links=False)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


OP7_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (token) WHERE a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS node FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.node
)
SELECT doc_id, n_shingles, component_id
FROM (SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles FROM sets) JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

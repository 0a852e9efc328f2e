"""Prefix tries of conversations: what can be computed once for all conversations that begin alike.

Conversations are laid out in the order of their turns by a range sort, so that a shard holds all that begins between
two others, and a prefix that many share is split wherever it is large. Each shard becomes a level-order trie: LOUDS
bits and an array of labels, rolled up from the last level to the first. Only nodes on the way to a shard's first and
last conversation may go on in the next shard; they are the upper levels, and are merged by a tree of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.op12_merkle import crc32_sql
from quillon.session import table, written

#: Turns of a shard, about.
PER_SHARD = 200_000
#: Shards whose upper levels are merged together.
FAN = 64
#: Ids of a row when a node's members travel.
IDS = 4096
#: Tasks over which the children of one upper node are dealt.
DEAL = 64
#: In the registered query: turns that a conversation may take from its hundred's first, at most, plus one.
TAKEN = 6
_NONE = hashlib.sha256(b"").hexdigest()
_MARK = 16


class Trie:
    """A trie in level order: `bits` has for each node a 1 for each child and a 0, after a 10 for the root; `labels` by node.

    Nodes are numbered as their ones stand, the root 0. Children of a node are next to each other, in order of label.
    """

    def __init__(self, degrees: np.ndarray, labels: np.ndarray, depth: np.ndarray) -> None:
        n = len(degrees)
        bits = np.ones(2 * n + 1, bool)
        bits[1] = False
        bits[2 + np.cumsum(degrees) + np.arange(n)] = False
        self.size, self.bits, self.labels = n, np.packbits(bits), labels
        self.levels = np.searchsorted(depth, np.arange(int(depth[-1]) + 2)).tolist()

    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=2 * self.size + 1).astype(bool)

    def parents(self) -> np.ndarray:
        """The parent of each node (root: -1): the zeros before its one, less one."""
        bits = self._bits()
        return np.cumsum(~bits)[bits] - 1

    def degrees(self) -> np.ndarray:
        """How many children each node has: the ones between two zeros."""
        return np.diff(np.flatnonzero(~self._bits())) - 1

    def walk(self, path: np.ndarray) -> list[int]:
        """The nodes from the root along labels that the trie has; it ends where there is no such child."""
        first = 1 + np.concatenate(([0], np.cumsum(self.degrees())))
        out = [0]
        for label in path:
            low, high = int(first[out[-1]]), int(first[out[-1] + 1])
            at = low + int(np.searchsorted(self.labels[low:high], label))
            if at == high or self.labels[at] != label:
                break
            out.append(at)
        return out

    def rolled(self, kept: np.ndarray, chars: np.ndarray, children: np.ndarray, convs: np.ndarray, low: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> None:
        """Sums over subtrees, in place, level by level from the last; what a kept node has is not passed on.

        convs and low begin with what ends at a node, or has been rolled up before; children has all children of the
        nodes that are not kept, of the kept ones those that have been counted before.
        """
        parent = self.parents()
        for a, b in reversed(list(zip(self.levels, self.levels[1:]))):
            done = np.arange(a, b)[~kept[a:b]]
            leaves[done] = np.where(children[done] == 0, 1, leaves[done])
            saved[done] += (convs[done] - 1) * chars[done]
            if a:
                up = parent[done]
                for total, part in ((convs, convs), (leaves, leaves), (saved, saved)):
                    np.add.at(total, up, part[done])
                np.minimum.at(low, up, low[done])
                np.add.at(children, up[kept[up]], 1)


def trie_of(marks: np.ndarray, lengths: np.ndarray) -> tuple[Trie, np.ndarray, np.ndarray, np.ndarray]:
    """(trie, depth of each node, where its label stands in marks, end node of each path) of sorted paths."""
    n = len(lengths)
    begin = np.cumsum(lengths) - lengths
    shared = np.zeros(n, np.int64)
    if n > 1:
        both = np.minimum(lengths[:-1], lengths[1:])
        k = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        differs = marks[np.repeat(begin[:-1], both) + k] != marks[np.repeat(begin[1:], both) + k]
        some = np.flatnonzero(both)
        shared[1:] = both
        if len(some):
            shared[1 + some] = np.minimum(both[some], np.minimum.reduceat(np.where(differs, k, np.iinfo(np.int64).max), (np.cumsum(both) - both)[some]))
    new = lengths - shared
    conv = np.repeat(np.arange(n), new)
    depth = np.arange(len(conv)) - np.repeat(np.cumsum(new) - new, new) + np.repeat(shared, new) + 1
    order = np.lexsort((conv, depth))
    conv, depth = np.concatenate(([0], conv[order])), np.concatenate(([0], depth[order]))
    place = depth * n + conv
    parent = np.searchsorted(place, place[1:] - n, "right") - 1
    at = begin[conv] + depth - 1
    at[0] = 0
    labels = marks[at] if len(marks) else np.zeros(1, f"S{_MARK}")
    ends = np.searchsorted(place, lengths * n + np.arange(n), "right") - 1
    return Trie(np.bincount(parent, minlength=len(depth)), labels, depth), depth, at, ends


_FIELDS = (
    ("shard", T.LongType()), ("edge", T.BooleanType()), ("left", T.BooleanType()), ("right", T.BooleanType()), ("key", T.BinaryType()), ("parent_key", T.BinaryType()), ("label", T.BinaryType()),
    ("conv_id", T.LongType()), ("depth", T.LongType()), ("parent_conv_id", T.LongType()), ("n_convs", T.LongType()), ("n_children", T.LongType()), ("n_leaves", T.LongType()),
    ("saved_tokens", T.LongType()), ("chars", T.LongType()), ("ends_sha256", T.StringType()), ("part", T.LongType()), ("ids", T.BinaryType()),
)
_ROWS = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
_ARROW = pa.schema([(n, {T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(), T.StringType: pa.string()}[type(t)]) for n, t in _FIELDS])


def _table(size: int, **columns) -> pa.Table:
    return pa.table([pa.nulls(size, f.type) if columns.get(f.name) is None else pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)


def _keys(labels: list[bytes]) -> list[bytes]:
    """A name for each node along a path, the same in every shard."""
    out = [hashlib.md5(b"").digest()]
    for label in labels:
        out.append(hashlib.md5(out[-1] + label).digest())
    return out


def _bytes(labels: np.ndarray) -> list[bytes]:
    raw = labels.tobytes()
    return [raw[i : i + _MARK] for i in range(0, len(raw), _MARK)]


def shard_rows(t: pa.Table, shard: int) -> Iterator[pa.Table]:
    """The nodes of a shard's trie: whole ones, those that may go on in another shard (edge), and the members that end at these."""
    t = t.combine_chunks()
    ids = t.column("conv_id").to_numpy()
    chars = pa.compute.list_flatten(t.column("chars")).to_numpy()
    marks = np.frombuffer(b"".join(t.column("path").to_pylist()), f"S{_MARK}")
    lengths = pa.compute.list_value_length(t.column("chars")).to_numpy().astype(np.int64)
    trie, depth, at, ends = trie_of(marks, lengths)
    n = trie.size
    parent, children = trie.parents(), trie.degrees().astype(np.int64)
    last = chars[at].astype(np.int64) if len(chars) else np.zeros(n, np.int64)
    last[0] = 0
    sides = [trie.walk(marks[: lengths[0]]), trie.walk(marks[len(marks) - lengths[-1] :])]
    kept = np.zeros(n, bool)
    kept[np.concatenate(sides)] = True
    whole = children.copy()
    whole[kept] = 0
    convs, low = np.bincount(ends, minlength=n).astype(np.int64), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, ends, ids)
    cut = np.concatenate(([0], np.flatnonzero(ends[1:] != ends[:-1]) + 1, [len(ends)]))
    members = {int(ends[a]): ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())}
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)
    trie.rolled(kept, last, whole, convs, low, leaves, saved)

    keys: dict[int, bytes] = {}
    for path in sides:
        keys |= zip(path, _keys(_bytes(trie.labels[path[1:]])))
    done = np.flatnonzero(~kept)
    up = parent[done]
    above = pa.array(low[up], mask=kept[up])
    told = [hashlib.sha256(",".join(map(str, members[v].tolist())).encode()).hexdigest() if v in members else _NONE for v in done.tolist()]
    yield _table(
        len(done), shard=np.full(len(done), shard), edge=np.zeros(len(done), bool), conv_id=low[done], depth=depth[done], parent_conv_id=above, parent_key=[keys.get(p) for p in up.tolist()],
        n_convs=convs[done], n_children=whole[done], n_leaves=leaves[done], saved_tokens=saved[done], ends_sha256=told,
    )
    edge = np.flatnonzero(kept)
    yield _table(
        len(edge), shard=np.full(len(edge), shard), edge=np.ones(len(edge), bool), left=np.isin(edge, sides[0]), right=np.isin(edge, sides[1]), key=[keys[v] for v in edge.tolist()],
        parent_key=[keys[parent[v]] if v else None for v in edge.tolist()], label=_bytes(trie.labels[edge]), conv_id=low[edge], depth=depth[edge], n_convs=convs[edge], n_children=whole[edge],
        n_leaves=leaves[edge], saved_tokens=saved[edge], chars=last[edge],
    )
    sent = [(keys[v], k, members[v][k : k + IDS].tobytes()) for v in edge.tolist() if v in members for k in range(0, len(members[v]), IDS)]
    if sent:
        key, part, packed = zip(*sent)
        yield _table(len(sent), shard=np.full(len(sent), shard), key=list(key), part=list(part), ids=list(packed))


def merged(t: pa.Table, fan: int, close: bool) -> pa.Table:
    """The edge nodes of neighbouring shards as one trie: those that are not on its own edges, or all, become whole."""
    shard = t.column("shard").to_numpy()
    first, last = shard == shard.min(), shard == shard.max()
    outer = np.zeros(len(shard), bool) if close else (first & t.column("left").to_numpy(zero_copy_only=False).astype(bool)) | (last & t.column("right").to_numpy(zero_copy_only=False).astype(bool))
    key = np.array([np.void(k) for k in t.column("key").to_pylist()], f"V{_MARK}")
    names = np.frombuffer(key.tobytes(), ">u8").reshape(-1, 2)
    _, one, back = np.unique(names, axis=0, return_index=True, return_inverse=True)
    back = back.reshape(-1)
    depth = t.column("depth").to_numpy()[one]
    index = {k: i for i, k in enumerate(np.asarray(t.column("key").to_pylist(), object)[one])}
    above = [index.get(k, -1) for k in np.asarray(t.column("parent_key").to_pylist(), object)[one]]
    labels = np.frombuffer(b"".join(t.column("label").to_pylist()), f"S{_MARK}")[one]
    #: Level order: a level's nodes by the place of their parent, then by label.
    order = np.empty(0, np.int64)
    place = np.zeros(len(one), np.int64)
    above = np.array(above)
    for d in range(int(depth.max()) + 1):
        level = np.flatnonzero(depth == d)
        level = level[np.lexsort((labels[level], place[above[level]]))] if d else level
        place[level] = len(order) + np.arange(len(level))
        order = np.concatenate((order, level))
    parent = np.where(above[order] >= 0, place[above[order]], -1)
    trie = Trie(np.bincount(parent[1:], minlength=len(order)), labels[order], depth[order])
    n = trie.size
    to = place[back]

    def summed(name: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.add.at(out, to, t.column(name).to_numpy())
        return out

    kept = np.zeros(n, bool)
    kept[to[outer]] = True
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, to, t.column("conv_id").to_numpy())
    convs, leaves, saved, children = (summed(c) for c in ("n_convs", "n_leaves", "saved_tokens", "n_children"))
    chars = t.column("chars").to_numpy()[one][order]
    children[~kept] += trie.degrees()[~kept]
    trie.rolled(kept, chars, children, convs, low, leaves, saved)
    sides = [np.zeros(n, bool), np.zeros(n, bool)]
    for side, rows, name in ((sides[0], first, "left"), (sides[1], last, "right")):
        side[to[rows & t.column(name).to_numpy(zero_copy_only=False).astype(bool)]] = True
    pick = one[order]
    return _table(
        n, shard=np.full(n, shard[0] // fan), edge=kept, left=sides[0], right=sides[1], key=t.column("key").take(pick).to_pylist(), parent_key=t.column("parent_key").take(pick).to_pylist(),
        label=t.column("label").take(pick).to_pylist(), conv_id=low, depth=depth[order], n_convs=convs, n_children=children, n_leaves=leaves, saved_tokens=saved, chars=chars,
    )


def _hashed(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): members of a node, ascending, streamed through one hash however many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                text = ",".join(map(str, np.frombuffer(ids, np.int64).tolist()))
                if k == key:
                    text = f",{text}"
                else:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return members.repartition("key").sortWithinPartitions("key", "shard", "part").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_nodes(paths: DataFrame, *, per_shard: int = PER_SHARD, fan: int = FAN) -> DataFrame:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of all paths.

    paths: (conv_id, path, chars), conv_id unique and not null, path 16 bytes a turn (binary) and chars the turns' code
    points (array). A conversation is one record: its turns, 20 bytes each, must fit a task. Equal conversations are
    members of the same nodes; a turnless one ends at the root. No conversations give no nodes.
    """
    spark = paths.sparkSession
    paths = written(paths.select("conv_id", "path", "chars"), "paths")
    turns = paths.agg(F.sum(F.size("chars"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // per_shard)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            for rows in shard_rows(pa.Table.from_batches(held), TaskContext.get().partitionId()):
                yield from rows.to_batches(max_chunksize=10_000)

    laid = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    tries = written(laid.mapInArrow(build, _ROWS), "tries")
    ends = _hashed(tries.where("ids IS NOT NULL"))
    edges, finals = tries.where("edge"), []
    last = edges.agg(F.max("shard")).first()[0]
    while last is not None:
        close = last < fan

        def merge(t: pa.Table) -> pa.Table:
            return merged(t, fan, close)

        up = written(edges.groupBy(F.floor(F.col("shard") / fan).alias("group")).applyInArrow(merge, _ROWS), "upper")
        finals.append(up.where("NOT edge"))
        edges, last = up.where("edge"), None if close else last // fan
    whole = tries.where("NOT edge")
    if not finals:
        return _result(whole)
    upper = finals[0]
    for more in finals[1:]:
        upper = upper.union(more)
    upper = written(upper.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE))).select(_ROWS.names), "upper_nodes")
    names = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    open_ = whole.where("parent_key IS NOT NULL").union(upper).withColumn("deal", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(DEAL)).cast("int"))
    resolved = open_.join(names, ["parent_key", "deal"], "left").withColumn("parent_conv_id", F.col("named"))
    return _result(whole.where("parent_key IS NULL")).union(_result(resolved))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns (mark, chars) in order.

    Turns ascend by turn, null first; equal ones by the digest of role and text, so that the order of rows plays no
    part. A null role or text is empty. Rows without a conv_id belong to no conversation and are left out; repeated
    rows are repeated turns. Other columns play no part.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    each = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), mark.alias("mark"), F.char_length(text).alias("chars")).alias("t")
    )
    return each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("seq")).select("conv_id", F.transform("seq", lambda t: F.struct(t["mark"], t["chars"])).alias("seq"))


def paths_of(lists: DataFrame) -> DataFrame:
    """(conv_id, path, chars) of (conv_id, seq)."""
    path = F.unhex(F.array_join(F.transform("seq", lambda t: F.hex(t["mark"])), ""))
    return lists.select("conv_id", path.alias("path"), F.transform("seq", lambda t: t["chars"]).alias("chars"))


def rebuilt(lists: DataFrame, taken: int = TAKEN) -> DataFrame:
    """Every conversation with its first turns taken from that of its hundred: h = crc32(id) mod `taken`, all if fewer, none if it is absent."""
    lists = written(lists, "turns")
    first = lists.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("seq", 1, taken - 1).alias("first"))
    own = lists.withColumn("base", F.expr("conv_id - conv_id % 100")).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % taken).cast("int"))
    begun = F.expr("slice(coalesce(first, slice(seq, 1, 0)), 1, h)")
    return own.join(first, "base", "left").select("conv_id", F.concat(begun, F.expr("slice(seq, h + 1, size(seq))")).alias("seq"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_nodes(paths_of(rebuilt(turn_lists(table(spark, sf_dir, "conversations")))))


OP13_SQL = f"""
WITH t AS (
    SELECT conv_id, md5(octet_length(encode(role)) || ':' || role || text) AS mark, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text)) AS i
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), h AS (SELECT conv_id, {crc32_sql('conv_id')} % {TAKEN} AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
    SELECT t.conv_id, i, mark, chars FROM t JOIN h USING (conv_id) WHERE i > h
    UNION ALL SELECT h.conv_id, i, mark, chars FROM h JOIN t ON t.conv_id = h.base AND t.i <= h.h
), seq AS (SELECT h.conv_id, list(mark ORDER BY i) FILTER (mark IS NOT NULL) AS marks, list(chars ORDER BY i) FILTER (mark IS NOT NULL) AS chars FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id),
s AS (SELECT conv_id, coalesce(marks, []) AS marks, coalesce(chars, []) AS chars FROM seq),
e AS (
    SELECT conv_id, len(marks) AS turns, d AS depth, array_to_string(marks[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(marks[1:d - 1], '') END AS parent, coalesce(chars[d], 0) AS chars
    FROM s, unnest(range(len(marks) + 1)) r(d)
), n AS (
    SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256 FROM e GROUP BY node
), c AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.parent = n.node),
u AS (
    SELECT e.node, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved_tokens
    FROM w JOIN e ON e.conv_id = w.conv_id AND e.depth <= w.depth GROUP BY e.node
)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN u USING (node) LEFT JOIN w p ON p.node = w.parent
"""

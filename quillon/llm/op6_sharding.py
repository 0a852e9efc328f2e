"""Sharding by histogram sort: splitters refined from exact byte counts, then one exchange. DataFrame functions only."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.session import table, written

#: Bits of the key that one round of probes resolves.
BITS = 10


def _place(sizes: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """Shard of each oversized row, the largest first to the least loaded, and the loads."""
    loads = [(0, s) for s in range(shards)]
    at = {}
    for rid, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = loads[0]
        at[rid] = s
        heapq.heapreplace(loads, (load + size, s))
    return at, [x for x, _ in sorted(loads, key=lambda x: x[1])]


def _quotas(loads: list[int], rest: int) -> list[float]:
    """Bytes that each shard takes of the rest, so that the lower loads come level."""
    order, level, left = sorted(loads), 0.0, float(rest)
    for k in range(1, len(order) + 1):
        gap = (order[k] - order[k - 1]) * k if k < len(order) else left
        if gap >= left:
            level = order[k - 1] + left / k
            break
        left -= gap
    return [max(0.0, level - x) for x in loads]


def _refine(rows: DataFrame, targets: dict[int, float], tolerance: float) -> list[tuple[int, int]]:
    """Cuts (key, row) with bytes below nearest to the targets; a row belongs above a cut unless it is below it.

    Each round counts the exact bytes of the buckets that hold a target, 2**BITS probes for each, over all
    partitions; it ends when every such bucket is within the tolerance or a single row.
    """
    cuts: dict[int, tuple[int, int]] = {}
    top = rows.agg(F.max("key"), F.max("rid")).first()
    bits = [max(1, int(x or 0).bit_length()) for x in top]
    #: For each open target: (prefix that holds it, bytes below that prefix).
    open_ = {i: ((0, 0), 0) for i in targets}
    for phase, column in enumerate(("key", "rid")):
        shift = bits[phase]
        while open_ and shift > 0:
            step = min(BITS, shift)
            shift -= step
            held = sorted({p for p, _ in open_.values()})
            key_at = [k for k, _ in held]
            if phase == 0:
                here = rows.where(F.shiftright("key", shift + step).isin(key_at))
                cells = here.groupBy(F.shiftright("key", shift).alias("p"), F.lit(0).cast("long").alias("q"))
            else:
                here = rows.where(F.struct("key", F.shiftright("rid", shift + step)).isin([F.struct(F.lit(k).cast("long"), F.lit(r).cast("long")) for k, r in held]))
                cells = here.groupBy(F.col("key").alias("p"), F.shiftright("rid", shift).alias("q"))
            counted = sorted((r["p"], r["q"], r["bytes"], r["n"]) for r in cells.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
            still = {}
            for i, ((key, rid), below) in open_.items():
                inside = [c for c in counted if (c[0] >> step == key if phase == 0 else (c[0], c[1] >> step) == (key, rid))]
                for p, q, size, n in inside:
                    if below + size >= targets[i] or (p, q) == inside[-1][:2]:
                        low, high = ((p << shift, 0), ((p + 1) << shift, 0)) if phase == 0 else ((p, q << shift), (p, (q + 1) << shift))
                        if size <= tolerance or n == 1 or (phase and not shift):
                            cuts[i] = low if targets[i] - below < below + size - targets[i] else high
                        else:
                            still[i] = ((p, q), below)
                        break
                    below += size
                else:
                    cuts[i] = (0, 0)
            open_ = still
        open_ = {i: ((p[0], 0), below) for i, (p, below) in open_.items()}
    out, last = [], (0, 0)
    for i in sorted(targets):
        last = max(last, cuts[i])
        out.append(last)
    return out


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16, oversized: int = 64, tolerance: float = 1e-3) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near equal bytes, ordered by id, slots gapless from 0.

    A row's size is the bytes of its text (none for null) plus `overhead`. Rows larger than a shard's share over
    `oversized` are, by that bound, at most shards * oversized; they go, the largest first, to the least loaded
    shard. All others are split by key (the id; a null one is lowest) where the exact bytes below are nearest to
    what each shard still lacks, so loads differ by no more than 1/`oversized` of a share, or one row where a
    single row exceeds a share. Equal ids, repeated rows too, are told apart by position. Other columns are left out.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + overhead
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = written(named.withColumn("rid", F.monotonically_increasing_id()), "sized")
    seen = rows.agg(F.sum("size"), F.count("*"), F.min(F.shiftright("doc_id", 1))).first()
    total, n, least = seen[0] or 0, seen[1], seen[2] or 0
    share = total / shards
    rows = rows.withColumn("key", F.coalesce(F.shiftright("doc_id", 1) - least + 1, F.lit(0)))
    big = F.col("size") > share / oversized
    placed, loads = _place([(r["rid"], r["size"]) for r in rows.where(big).select("rid", "size").collect()], shards)
    rest = total - sum(loads)
    quotas = _quotas(loads, rest)
    targets, at = {}, 0.0
    for i, q in enumerate(quotas[:-1]):
        at += q
        targets[i] = at
    cuts = _refine(rows.where(~big), targets, tolerance * share) if rest else []

    def above(cut: tuple[int, int]) -> Column:
        return ((F.col("key") > cut[0]) | ((F.col("key") == cut[0]) & (F.col("rid") >= cut[1]))).cast("int")

    by_key = sum((above(c) for c in cuts), F.lit(0))
    if placed:
        fixed = spark.createDataFrame(list(placed.items()), "rid long, fixed int")
        rows = rows.join(F.broadcast(fixed), "rid", "left").withColumn("shard", F.coalesce("fixed", by_key))
    else:
        rows = rows.withColumn("shard", by_key)
    # Slots: each shard in parts of bounded rows, a part after the other.
    parts = max(8, -(-n // (shards * 200_000)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)))
    each = rows.groupBy("shard", "part").agg(F.count("*").alias("in_part"))
    first = each.withColumn("first", F.sum("in_part").over(Window.partitionBy("shard").orderBy("part")) - F.col("in_part")).drop("in_part")
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "rid")) - 1
    slotted = rows.withColumn("number", number).join(first, ["shard", "part"])
    return slotted.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("number")).cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

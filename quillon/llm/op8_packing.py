"""Packing by balanced cost: documents become sequences of bounded length with little padding."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.vocab import added_tokens, encoder, ids_of, rank_bytes
from quillon.session import table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Open:
    """Open sequences by room left; the cheapest with room for n is found in O(log size)."""

    def __init__(self, size: int, count: int) -> None:
        self.size, self.width = size, 1 << size.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
        self.heaps[size] = [(0.0, s) for s in range(count)]
        self.tree: list[tuple[float, int, int] | None] = [None] * (2 * self.width)
        self._set(size)

    def _set(self, room: int) -> None:
        heap = self.heaps[room]
        i = self.width + room
        self.tree[i] = (*heap[0], room) if heap else None
        while i > 1:
            i //= 2
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = b if a is None else a if b is None or a <= b else b

    def cheapest(self, least: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest open sequence with at least that room."""
        lo, hi, best = self.width + least, self.width + self.size + 1, None
        while lo < hi:
            if lo & 1:
                if (x := self.tree[lo]) is not None and (best is None or x < best):
                    best = x
                lo += 1
            if hi & 1:
                hi -= 1
                if (x := self.tree[hi]) is not None and (best is None or x < best):
                    best = x
            lo, hi = lo // 2, hi // 2
        return best

    def fill(self, cost: float, seq: int, room: int, n: int, more: float) -> None:
        """Put n tokens of that cost into the sequence, the head of its heap."""
        heapq.heappop(self.heaps[room])
        self._set(room)
        if room > n:
            heapq.heappush(self.heaps[room - n], (cost + more, seq))
            self._set(room - n)


def assign(lengths: list[int], size: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document index, start, length, sequence, offset) of every piece; sequences count from 0.

    Whole stretches of `size` tokens are full sequences. What remains of each document goes, the costliest
    first, to the cheapest sequence with room; a piece that fits nowhere is cut to fill the cheapest open one.
    Cost of a piece of n tokens: n + quadratic * n * n.
    """
    out: list[tuple[int, int, int, int, int]] = []
    items: list[tuple[int, int, int]] = []
    full = 0
    for k, n in enumerate(lengths):
        whole = n // size
        for j in range(whole):
            out.append((k, j * size, size, full, 0))
            full += 1
        if n % size:
            items.append((-(n % size), k, whole * size))
    heapq.heapify(items)
    count = -(-sum(-x for x, _, _ in items) // size)
    used = [0] * count
    room_by = _Open(size, count)
    while items:
        left, k, start = heapq.heappop(items)
        n = -left
        cost, seq, room = room_by.cheapest(n) or room_by.cheapest(1)
        put = min(n, room)
        out.append((k, start, put, full + seq, used[seq]))
        used[seq] += put
        room_by.fill(cost, seq, room, put, put + quadratic * put * put)
        if put < n:
            heapq.heappush(items, (put - n, k, start + put))
    return out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, end_id: int = 0, max_tokens: int = 1024, block_tokens: int = 1 << 22, quadratic: float = 1 / 1024, with_ids: bool = True) -> DataFrame:
    """Pack every document's ids, then `end_id`, into sequences of at most `max_tokens`.

    The default vocabulary's added tokens (<|endoftext|>) are one id each where a text spells them out, as its
    tokenizer file has it; a rank file names none. A null text counts as empty: its document is `end_id` alone. Documents are packed in blocks of about
    `block_tokens` tokens of one input partition, in one pass without a shuffle; within a block less than
    `max_tokens` of padding is left, however large a document is. Repeated rows are packed once each; a null id
    stays null. Ties go by position in the block. Other columns are ignored. `sequence_id` is unique over blocks
    (partition number times 2**33 plus a count); `ids` holds little-endian 32-bit ids, null without `with_ids`.
    """
    raw = docs.sparkSession.sparkContext.broadcast(rank_bytes(vocab_path))
    added = {} if vocab_path else added_tokens()
    parts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(raw.value, added)
        base = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        block: list[tuple[int | None, bytes]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            pieces = assign([len(x) // 4 for _, x in block], max_tokens, quadratic)
            base_now, last = base, -1
            rows: list[tuple] = []
            for k, start, n, seq, offset in pieces:
                doc_id, ids = block[k]
                data = ids[4 * start : 4 * (start + n)]
                rows.append((doc_id, start, n, zlib.crc32(data), len(ids) // 4, base_now + seq, offset, data if with_ids else None))
                last = max(last, seq)
                if len(rows) == 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            base += last + 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(enc, text.as_py() or "", named=bool(added)) + end
                block.append((doc_id, ids))
                held += len(ids) // 4
                if held >= block_tokens:
                    yield from flush()
                    block, held = [], 0
        if block:
            yield from flush()

    return parts.mapInArrow(blocks, SCHEMA)


_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of every document, with their ids, by sequence and offset."""
    return pack(docs)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")

"""Byte-level BPE encoding and decoding as a monoid tree reduction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.vocab import encoder, ordinary, rank_bytes
from quillon.session import table


class Monoid:
    """Encodings of texts under concatenation: `join` makes the ids of a + b from those of a and of b.

    A space whose predecessor is no white space always begins a match of the split pattern, and no match before
    it looks past it. A window that reaches from such a space left of the seam to such a space right of it
    therefore has, re-encoded, the very ids that the whole has there, and the ids outside stay as they are.
    Windows double until they hold such a space on either side, or the whole side.
    """

    def __init__(self, raw: bytes, leaf: int = 4096, window: int = 32) -> None:
        self.enc, self.lengths = encoder(raw)
        self.leaf, self.window = leaf, window

    def _left(self, text: str) -> int:
        w = self.window
        while w < len(text):
            at = text.rfind(" ", len(text) - w)
            while at > 0 and text[at - 1].isspace():
                at = text.rfind(" ", len(text) - w, at)
            if at > 0:
                return at
            w *= 2
        return 0

    def _right(self, text: str) -> int:
        w = self.window
        while w < len(text):
            at = text.find(" ", 1, w)
            while at > 0 and text[at - 1].isspace():
                at = text.find(" ", at + 1, w)
            if at > 0:
                return at
            w *= 2
        return len(text)

    def _count(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids hold exactly that many bytes."""
        held = np.cumsum(self.lengths[ids[:size]])
        k = int(np.searchsorted(held, size)) + 1 if size else 0
        if k and held[k - 1] != size:
            raise AssertionError("a window does not end between two ids")
        return k

    def join(self, a: str, a_ids: np.ndarray, b: str, b_ids: np.ndarray) -> np.ndarray:
        """The ids of a + b."""
        p, q = self._left(a), self._right(b)
        keep = len(a_ids) - self._count(a_ids[::-1], len(a[p:].encode()))
        drop = self._count(b_ids, len(b[:q].encode()))
        seam = np.array(ordinary(self.enc, a[p:] + b[:q]), "<u4")
        return np.concatenate((a_ids[:keep], seam, b_ids[drop:]))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: halves recursively, joined upwards."""
        if len(text) <= self.leaf:
            return np.array(ordinary(self.enc, text), "<u4")
        mid = len(text) // 2
        a, b = text[:mid], text[mid:]
        return self.join(a, self.encode(a), b, self.encode(b))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: halves recursively, concatenated upwards."""
        if len(ids) <= self.leaf:
            return self.enc.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_MONOIDS: dict[str, Monoid] = {}


def _monoid(raw: bytes, leaf: int) -> Monoid:
    key = f"{leaf}-{hashlib.md5(raw).hexdigest()}"
    if key not in _MONOIDS:
        _MONOIDS[key] = Monoid(raw, leaf)
    return _MONOIDS[key]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, leaf: int = 4096) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens) of every text, as tiktoken's encode_ordinary gives them.

    A null text counts as empty and has no ids. Rows are independent of each other: repeated rows and null ids
    are kept as they are, other columns are left out. A text of any length takes memory in proportion to itself.
    """
    raw = docs.sparkSession.sparkContext.broadcast(rank_bytes(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _monoid(raw.value, leaf)
        for batch in batches:
            ids = [m.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decode(tokens: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocab_path: str | None = None, leaf: int = 4096) -> DataFrame:
    """(doc_id, data binary) of every row of ids; null or no ids give no bytes, an unknown id raises."""
    raw = tokens.sparkSession.sparkContext.broadcast(rank_bytes(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _monoid(raw.value, leaf)
        for batch in batches:
            data = [m.decode(np.array(x.as_py() or [], "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, leaf: int = 4096) -> DataFrame:
    """Encode and decode every text in one pass; return (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    raw = docs.sparkSession.sparkContext.broadcast(rank_bytes(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _monoid(raw.value, leaf)
        for batch in batches:
            n, before, after = [], [], []
            for x in batch.column(1):
                ids = m.encode(x.as_py() or "")
                n.append(len(ids))
                before.append(hashlib.sha256(ids.tobytes()).hexdigest())
                after.append(hashlib.sha256(m.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, encoded and decoded again, as digests."""
    return digests(table(spark, sf_dir, "documents"))

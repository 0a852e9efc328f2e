"""Media columns: types sniffed from signatures, confirmed by structure, embedded media carved out."""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.session import table

_U4L, _U4B, _U2B = struct.Struct("<I"), struct.Struct(">I"), struct.Struct(">H")
#: Bytes that are unpacked at once where a packed stream is confirmed.
UNPACKED = 1 << 16


class Data:
    """Bytes that are asked many times for what follows a place: marks are located once, chains of blocks walked once."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self._marks: dict[bytes, list[int]] = {}
        self._known: dict[tuple, object] = {}

    def find(self, mark: bytes, at: int) -> int:
        """Where a mark stands first from `at` on; -1 if nowhere."""
        if mark not in self._marks:
            self._marks[mark] = [m.start() for m in re.finditer(b"(?=" + re.escape(mark) + b")", self.data, re.S)]
        places = self._marks[mark]
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def chain(self, step: Callable[[bytes, int], tuple[int, bool] | None], p: int, *more: int) -> int | None:
        """Where the chain of blocks from p ends: step(data, p, ...) gives the next place and whether that is the end, or None.

        What a walk has found holds for every place on its way, so places that lead into a known chain are not walked again.
        """
        way, key = [], (step, p, *more)
        end: int | None = None
        while True:
            if key in self._known:
                end = self._known[key]
                break
            way.append(key)
            if (told := step(self.data, p, *more)) is None:
                break
            p, done = told
            if done:
                end = p
                break
            key = (step, p, *more)
        for k in way:
            self._known[k] = end
        return end


def _riff_chunk(b: bytes, p: int, end: int) -> tuple[int, bool] | None:
    if p + 8 > end:
        return None
    n = _U4L.unpack_from(b, p + 4)[0]
    p += 8 + n + n % 2
    return p, p == end


def _riff(d: Data, at: int) -> int | None:
    """End of a RIFF file: its length, and chunks that fill it exactly."""
    b = d.data
    if at + 12 > len(b):
        return None
    end = at + 8 + _U4L.unpack_from(b, at + 4)[0]
    if end > len(b) or end < at + 12:
        return None
    return end if end == at + 12 else d.chain(_riff_chunk, at + 12, end)


def _wave(d: Data, at: int) -> int | None:
    return _riff(d, at) if d.data[at + 8 : at + 12] == b"WAVE" and d.data[at + 12 : at + 16] == b"fmt " else None


def _webp(d: Data, at: int) -> int | None:
    return _riff(d, at) if d.data[at + 8 : at + 12] == b"WEBP" else None


def _png_length(b: bytes, p: int) -> tuple[int, bool] | None:
    """The next chunk by lengths alone."""
    if p + 12 > len(b):
        return None
    n = _U4B.unpack_from(b, p)[0]
    return (p + 12 + n, b[p + 4 : p + 8] == b"IEND") if p + 12 + n <= len(b) else None


def _png_chunk(b: bytes, p: int) -> tuple[int, bool] | None:
    told = _png_length(b, p)
    return told if told and zlib.crc32(memoryview(b)[p + 4 : told[0] - 4]) == _U4B.unpack_from(b, told[0] - 4)[0] else None


def _png(d: Data, at: int) -> int | None:
    """Chunks from a header of 13 bytes to the end mark; their lengths are looked at before their sums."""
    if d.data[at + 8 : at + 16] != b"\0\0\0\x0dIHDR" or d.chain(_png_length, at + 8) is None:
        return None
    return d.chain(_png_chunk, at + 8)


def _gif_data(b: bytes, p: int) -> tuple[int, bool] | None:
    """The next block of data; the empty one ends these."""
    return (p + 1 + b[p], not b[p]) if p < len(b) else None


def _gif(d: Data, at: int) -> int | None:
    b = d.data
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return None
    flags = b[at + 10]
    p: int | None = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    key, way, end = ("gif", p), [], None
    while p is not None and p < len(b):
        key = ("gif", p)
        if key in d._known:
            end = d._known[key]
            break
        way.append(key)
        kind = b[p]
        if kind == 0x3B:
            end = p + 1
            break
        if kind == 0x2C and p + 11 <= len(b):
            local = b[p + 9]
            p += 11 + (3 << ((local & 7) + 1) if local & 128 else 0)
        elif kind == 0x21:
            p += 2
        else:
            break
        p = d.chain(_gif_data, p)
    for k in way:
        d._known[k] = end
    return end


def _jpeg_segment(b: bytes, p: int) -> tuple[int, bool] | None:
    """The next segment; that before the samples is the last."""
    if p + 4 > len(b) or b[p] != 0xFF:
        return None
    kind, n = b[p + 1], _U2B.unpack_from(b, p + 2)[0]
    return (p + 2 + n, kind == 0xDA) if n >= 2 and kind >= 0xC0 else None


def _jpeg(d: Data, at: int) -> int | None:
    p = d.chain(_jpeg_segment, at + 2)
    end = d.find(b"\xff\xd9", p) if p is not None else -1
    return end + 2 if end >= 0 else None


def _bmp(d: Data, at: int) -> int | None:
    b = d.data
    if at + 26 > len(b):
        return None
    size, _, start, header = struct.unpack_from("<IIII", b, at + 2)
    return at + size if header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(b) - at else None


def _unpacked(d: Data, at: int) -> tuple[int, int, int] | None:
    """(end, crc32, size) of the packed stream at a place; its parts are unpacked one at a time and thrown away."""
    key = (_unpacked, at)
    if key not in d._known:
        unpack, p, step, crc, size, found = zlib.decompressobj(-15), at, 256, 0, 0, None
        try:
            while not unpack.eof:
                if unpack.unconsumed_tail:
                    part = unpack.decompress(unpack.unconsumed_tail, UNPACKED)
                elif p < len(d.data):
                    part = unpack.decompress(d.data[p : p + step], UNPACKED)
                    p, step = p + step, min(2 * step, UNPACKED)
                else:
                    break
                crc, size = zlib.crc32(part, crc), size + len(part)
            else:
                found = min(p, len(d.data)) - len(unpack.unused_data), crc, size
        except zlib.error:
            pass
        d._known[key] = found
    return d._known[key]


def _gzip(d: Data, at: int) -> int | None:
    """The end of a stream behind a whole header, whose sum and size are those of what it unpacks to."""
    b = d.data
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    flags, p = b[at + 3], at + 10
    if flags & 4:
        p += 2 + int.from_bytes(b[p : p + 2], "little")
    for named in (8, 16):
        if flags & named:
            if (zero := d.find(b"\0", p)) < 0:
                return None
            p = zero + 1
    if (found := _unpacked(d, p + (flags & 2))) is None or found[0] + 8 > len(b):
        return None
    end, crc, size = found
    return end + 8 if struct.unpack_from("<II", b, end) == (crc, size & 0xFFFFFFFF) else None


def _pdf(d: Data, at: int) -> int | None:
    if not d.data[at + 5 : at + 6].isdigit() or (end := d.find(b"%%EOF", at)) < 0:
        return None
    return end + 5 if 0 <= d.find(b"startxref", at) <= end - 9 else None


def _zip(d: Data, at: int) -> int | None:
    end = d.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(d.data):
        return None
    size, start, note = struct.unpack_from("<IIH", d.data, end + 12)
    return end + 22 + note if at + start + size == end and end + 22 + note <= len(d.data) else None


#: Magic bytes of each type, as the formats' specifications give them.
MAGIC: list[tuple[bytes, str, Callable[[Data, int], int | None]]] = [
    (b"RIFF", "wav", _wave),
    (b"RIFF", "webp", _webp),
    (b"\x89PNG\r\n\x1a\n", "png", _png),
    (b"GIF8", "gif", _gif),
    (b"\xff\xd8\xff", "jpeg", _jpeg),
    (b"BM", "bmp", _bmp),
    (b"\x1f\x8b\x08", "gzip", _gzip),
    (b"%PDF-", "pdf", _pdf),
    (b"PK\x03\x04", "zip", _zip),
]
_AUTOMATON: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for magic in dict.fromkeys(m for m, _, _ in MAGIC):
            a.add_word(magic.decode("latin-1"), (len(magic), [(t, f) for m, t, f in MAGIC if m == magic]))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(data: bytes | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of all media that their structure confirms, by start; the outer before what it holds.

    Of several signatures of a type whose media end at the same place the first is the medium, the others parts of it.
    """
    out, ends = [], set()
    if data:
        d = Data(data)
        for last, (n, kinds) in _automaton().iter(data.decode("latin-1")):
            for kind, confirm in kinds:
                if (end := confirm(d, last - n + 1)) is not None:
                    if (kind, end) not in ends:
                        ends.add((kind, end))
                        out.append((kind, last - n + 1, end))
                    break
    return out


def inspect(df: DataFrame, *, data_col: str = "data", declared_col: str | None = None) -> DataFrame:
    """All columns of df, then `media_type`, `corrected` and `carved` (array of type, start, end, bytes).

    `media_type` is what stands confirmed at byte 0, else the declared type, else null; `corrected` says whether
    it differs from a declared one. Carved are confirmed media elsewhere in the bytes. Null or empty bytes have
    nothing carved. Columns of df with these names are replaced; repeated rows are treated alike.
    """
    df = df.drop("media_type", "corrected", "carved")
    at = df.columns.index(data_col)
    declared_at = df.columns.index(declared_col) if declared_col else None
    carving = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("data", T.BinaryType())])
    schema = T.StructType([*df.schema.fields, T.StructField("media_type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("carved", T.ArrayType(carving))])
    struct_type = pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, corrected, carved = [], [], []
            declared = batch.column(declared_at).to_pylist() if declared_at is not None else [None] * batch.num_rows
            for x, said in zip(batch.column(at), declared):
                data = x.as_py()
                found = sniff(data)
                kind = next((k for k, start, _ in found if start == 0), said)
                kinds.append(kind)
                corrected.append(said is not None and kind != said)
                carved.append([{"type": k, "start": s, "end": e, "data": data[s:e]} for k, s, e in found if s])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(corrected, pa.bool_()), pa.array(carved, pa.list_(struct_type))], names=[*batch.schema.names, "media_type", "corrected", "carved"])

    return df.mapInArrow(run, schema)


#: Sample rate that stored payloads state.
RATE = 8000


def stored(payload: bytes) -> bytes:
    """A payload as samples of a mono 8-bit wave file; its length is even, so no chunk is padded."""
    n = len(payload)
    return b"".join((b"RIFF", _U4L.pack(36 + n), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8), b"data", _U4L.pack(n), payload))


def read_back(media: bytes) -> tuple[bytes, str]:
    """(samples, feature) of stored bytes, found by signature and structure, not by position.

    The feature names type, sample width, channels, rate, frames, and the types carved from within.
    """
    found = sniff(media)
    kind, start, end = next((x for x in found if x[1] == 0), ("", 0, 0))
    if kind != "wav":
        raise ValueError("stored bytes are no wave file")
    channels, rate, _, _, bits = struct.unpack_from("<HIIHH", media, start + 22)
    p = start + 12
    while media[p : p + 4] != b"data":
        n = _U4L.unpack_from(media, p + 4)[0]
        p += 8 + n + n % 2
    n = _U4L.unpack_from(media, p + 4)[0]
    inner = ",".join(k for k, s, _ in found if s)
    return media[p + 8 : p + 8 + n], f"{kind}:{bits}bit:{channels}ch:{rate}Hz:{n}:[{inner}]"


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """Store every text as 8-bit samples, read it back and describe it; one row a document.

    A null text counts as empty: its payload is `unit` bytes of 0. Payloads are padded with bytes 0 to a positive
    multiple of `unit`. Texts of 4 GB or more do not fit the format and raise. Repeated rows are treated alike,
    null ids stay null, other columns are left out.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (x.as_py() or "").encode()
                media = stored(data + bytes(-len(data) % unit or (0 if data else unit)))
                payload, feature = read_back(media)
                rows.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as media, read back, sniffed and described."""
    return digests(table(spark, sf_dir, "documents"))

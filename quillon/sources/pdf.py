"""Text of PDF files: objects, streams and text operators read directly; pages in the order of the page tree.

Covers what digital documents have: Flate and plain streams, object streams, simple fonts (one byte a character, by
their ToUnicode maps where there are any, else Latin-1) and composite fonts with ToUnicode maps. Encrypted files and
pages that are images are refused, for their text cannot be told.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.identity import root_id

#: Bytes that one stream may unpack to.
UNPACKED = 1 << 28
_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[+-]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\(\r\n|[0-7]{1,3}|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Unreadable(ValueError):
    """A file whose text cannot be told."""


def _unpacked(body: bytes) -> bytes:
    """A stream object's bytes; b"" where its filter is not one of text."""
    m = _STREAM.search(body)
    if not m:
        return b""
    head = body[: m.start()]
    if b"/FlateDecode" in head:
        d = zlib.decompressobj()
        out = d.decompress(m[1], UNPACKED)
        if d.unconsumed_tail:
            raise Unreadable("a stream unpacks to more than the bound")
        return out
    return b"" if b"/Filter" in head else m[1]


def _objects(data: bytes) -> dict[int, bytes]:
    """All objects by number, those in object streams included; of several of a number the last."""
    out = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body[:400]:
            inner = _unpacked(body)
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
            head = list(map(int, inner[:first].split()[: 2 * n]))
            ends = [*head[3::2], len(inner) - first]
            for number, a, b in zip(head[::2], head[1::2], ends):
                out.setdefault(number, inner[first + a : first + b])
    return out


def _value(body: bytes, name: bytes, objects: dict[int, bytes]) -> bytes:
    """What a dictionary has under a name, a reference followed; b"" where it has nothing."""
    m = re.search(rb"/" + name + rb"(?![A-Za-z])\s*", body)
    if not m:
        return b""
    rest = body[m.end() :]
    if ref := _REF.match(rest):
        return objects.get(int(ref[1]), b"")
    if rest[:2] == b"<<":
        depth = 0
        for t in re.finditer(rb"<<|>>", rest):
            depth += 1 if t[0] == b"<<" else -1
            if not depth:
                return rest[: t.end()]
    return rest.split(b"]")[0] + b"]" if rest[:1] == b"[" else rest


def _pages(objects: dict[int, bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(page, its resources) in the order of the page tree; resources are inherited."""
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    todo = [(_value(root, b"Pages", objects), b"")]
    seen = 0
    while todo:
        body, inherited = todo.pop()
        seen += 1
        if seen > 2 * len(objects) + 2:
            raise Unreadable("the page tree has a cycle")
        resources = _value(body, b"Resources", objects) or inherited
        if b"/Kids" in body:
            kids = [objects.get(int(r[1]), b"") for r in _REF.finditer(_value(body, b"Kids", objects))]
            todo += [(k, resources) for k in reversed(kids)]
        elif body:
            yield body, resources


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PLAIN.get(m[1], m[1]), token[1:-1])


def _unicode_map(stream: bytes) -> dict[bytes, str]:
    """A ToUnicode map: codes and what they stand for, from its single and its range entries."""
    read = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(code.decode())] = read(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", block):
            size, a, b = len(low) // 2, int(low, 16), int(high, 16)
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", to)
            for i in range(min(b - a, 0xFFFF) + 1):
                text = read(listed[i]) if to[:1] == b"[" and i < len(listed) else read(listed[0]) if listed else ""
                out[(a + i).to_bytes(size, "big")] = text if to[:1] == b"[" else text[:-1] + chr(ord(text[-1]) + i) if text else ""
    return out


def _decoded(raw: bytes, codes: dict[bytes, str]) -> str:
    if not codes:
        return raw.decode("latin-1")
    size = max(map(len, codes))
    return "".join(codes.get(raw[i : i + size], "" if size > 1 else raw[i : i + 1].decode("latin-1")) for i in range(0, len(raw), size))


def _shown(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """The text that a page's operators show; a move to another line ends a line, a wide gap is a blank."""
    out: list[str] = []
    args: list[bytes] = []
    codes: dict[bytes, str] = {}
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/+-.0123456789" and t not in (b"'", b'"'):
            args.append(t)
            continue
        if t == b"Tf" and len(args) >= 2:
            codes = fonts.get(args[-2][1:], {})
        elif t in (b"Td", b"TD", b"Tm", b"T*", b"'", b'"'):
            moved = t in (b"T*", b"'", b'"') or t == b"Tm" or (len(args) >= 2 and float(args[-1] if args[-1][:1] not in b"/([<" else 0) != 0)
            out.append("\n" if moved else " ")
        if t in (b"Tj", b"TJ", b"'", b'"'):
            for a in args:
                if a[:1] in b"(<":
                    out.append(_decoded(_string(a), codes))
                elif t == b"TJ" and a[:1] not in b"[]/" and float(a) < -200:
                    out.append(" ")
        args = []
    text = re.sub(r"[ \t]+", " ", "".join(out))
    return "\n".join(x for x in (line.strip() for line in text.split("\n")) if x)


def pdf_text(data: bytes) -> list[str]:
    """The text of each page; a file that is no PDF, is encrypted or has no text at all is refused."""
    if b"%PDF-" not in data[:1024]:
        raise Unreadable("not a PDF")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise Unreadable("encrypted")
    objects = _objects(data)
    pages = []
    for page, resources in _pages(objects):
        named = _value(resources, b"Font", objects)
        fonts = {name: _unicode_map(_unpacked(_value(objects.get(int(ref), b""), b"ToUnicode", objects))) for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", named)}
        where = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        parts = [_unpacked(objects.get(int(r[1]), b"")) for r in _REF.finditer(where[1])] if where else []
        pages.append(_shown(b"\n".join(parts), fonts))
    if not any(pages):
        raise Unreadable("no text: the pages may be images")
    return pages


def pdf_nodes(docs: DataFrame) -> DataFrame:
    """Root nodes (id, sources, content, page), one a page with text, of files (source_id, path, content); row-local.

    A file that cannot be read is refused with its path. Pages count from 1; pages without text have no node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, path, data in zip(batch.column("source_id").to_pylist(), batch.column("path").to_pylist(), batch.column("content")):
                try:
                    pages = pdf_text(data.as_py())
                except Unreadable as why:
                    raise Unreadable(f"{path}: {why}") from None
                rows += [([source], text, i) for i, text in enumerate(pages, 1) if text]
            sources, content, page = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.list_(pa.string())), pa.array(content, pa.string()), pa.array(page, pa.int32())], names=["sources", "content", "page"])

    out = docs.select("source_id", "path", "content").mapInArrow(run, "sources array<string>, content string, page int")
    return out.select(root_id(F.col("content"), F.col("page")).alias("id"), "sources", "content", "page")

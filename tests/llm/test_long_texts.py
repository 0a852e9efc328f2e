"""Texts of great length and of great regularity: right results, in seconds."""

import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import op2_pii, op3_bpe, op5_media, op8_packing, vocab

SECONDS = 30


def timed(f, most=SECONDS):
    began = time.perf_counter()
    out = f()
    assert time.perf_counter() - began < most
    return out


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 2_000_000 + " b", " \n\t" * 700_000 + "x", "x" * 2_000_000])
def test_long_runs_are_encoded(text):
    m = op3_bpe.Monoid(vocab.rank_bytes())
    ids = timed(lambda: m.encode(text))
    assert m.decode(ids) == text.encode()
    enc, _ = vocab.encoder(vocab.rank_bytes(), vocab.added_tokens())
    assert timed(lambda: vocab.ids_of(enc, text, named=True)) == ids.tobytes()


@pytest.mark.parametrize("run", [" ", "\n", " \n\t", "　", "\x0b\x85 "])
@pytest.mark.parametrize("after", ["", "x", " ", "'s", "\x1c", "<|endoftext|>", "12", "?"])
def test_long_runs_have_the_ids_of_short_ones(monkeypatch, run, after):
    """Cutting runs out changes no id, whatever stands before and after."""
    enc, _ = vocab.encoder(vocab.rank_bytes(), vocab.added_tokens())
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = f"one{run * 30}{after}" * 3
    monkeypatch.setattr(vocab, "_LONG_RUN", re.compile(f"[{vocab.BLANKS}]{{3,}}"))
    assert vocab.ordinary(enc, text) == enc.encode_ordinary(text)
    assert np.frombuffer(vocab.ids_of(enc, text, named=True), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_long_runs_are_packed(spark):
    docs = spark.createDataFrame([(1, " " * 2_000_000), (2, "a b")], "doc_id long, text string")
    got = timed(lambda: op8_packing.pack(docs, with_ids=False).groupBy("doc_id").sum("length").collect())
    assert {r[0]: r[1] for r in got} == {1: 2_000_001, 2: 3}
    assert {r["doc_id"]: r["n_tokens"] for r in op3_bpe.digests(docs).collect()} == {1: 2_000_000, 2: 2}


PNG = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", bytes(13)), (b"IDAT", b"x" * 50), (b"IEND", b"")))


@pytest.mark.parametrize(
    "data,want",
    [
        (b"%PDF-1 " * 100_000, []),
        (b"%PDF-1 " * 100_000 + b"startxref %%EOF", [("pdf", 0, 700_015)]),
        (b"PK\x03\x04" * 100_000, []),
        (b"\xff\xd8\xff" * 100_000, []),
        (b"GIF89a" + b"GIF89a" * 100_000, []),
        (b"RIFF\x00\x40\x00\x00WAVEfmt " * 100_000, []),
        (b"\x1f\x8b\x08" * 100_000, []),
        (b"BM" * 100_000, []),
        (PNG * 1000, [("png", i * len(PNG), (i + 1) * len(PNG)) for i in range(1000)]),
    ],
)
def test_signatures_that_repeat(data, want):
    assert timed(lambda: op5_media.sniff(data)) == want


def test_packed_streams_are_unpacked_in_parts():
    """A stream of a gigabyte of zeros is confirmed without holding it; what follows is not part of it."""
    pack = zlib.compressobj(9, zlib.DEFLATED, 31)
    packed = b"".join(pack.compress(bytes(1 << 24)) for _ in range(64)) + pack.flush()
    import tracemalloc

    tracemalloc.start()
    assert timed(lambda: op5_media.sniff(b"head" + packed + b"tail")) == [("gzip", 4, 4 + len(packed))]
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_very_many_addresses_in_one_text(spark):
    said = " ".join(f"word{'abcde'[i % 5]} u{i}@host{i % 97}.example" for i in range(100_000))
    docs = spark.createDataFrame([(1, said), (2, "none here")], "doc_id long, text string")
    got = timed(lambda: {r["doc_id"]: r for r in op2_pii.detect(docs).selectExpr("doc_id", "size(email) as n", "get(email, 99999) as last").collect()}, 4 * SECONDS)
    want = list(re.finditer(r"u\d+@host\d+\.example", said))[-1]
    assert got[1]["n"] == 100_000 and tuple(got[1]["last"]) == (want.start(), want.end(), want[0]) and got[2]["n"] == 0
    clean = timed(lambda: {r["doc_id"]: r["text"] for r in op2_pii.sanitise(docs).collect()}, 4 * SECONDS)
    assert clean[2] == "none here" and clean[1].count("[EMAIL]") == 100_000 and "@" not in clean[1]

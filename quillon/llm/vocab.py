"""Public tokenizer files: read on the driver, shipped to workers as bytes, parsed once per worker."""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import public_tokenizers
import tiktoken

#: Rank file of the byte-level vocabulary used by default; any file in the same format may be given.
RANKS = "byte_bpe_50k.tiktoken"
#: Its tokenizer file, which names the added tokens.
NAMED = "byte_bpe_50k.json"
#: The white space of the split pattern. A longer run than this is cut out before the pattern sees it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONGEST = 10_000
_LONG_RUN = re.compile(f"[{BLANKS}]{{{LONGEST},}}")
_BUILT: dict[str, tuple] = {}


def rank_bytes(path: str | None = None) -> bytes:
    """The rank file's content."""
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return f.read()


def added_tokens() -> dict[str, int]:
    """The default vocabulary's added tokens and their ids."""
    with open(public_tokenizers.path(NAMED), encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def encoder(raw: bytes, added: dict[str, int] | None = None) -> tuple[tiktoken.Encoding, np.ndarray]:
    """(encoding with the added tokens as its special ones, byte length of each other token by id)."""
    key = hashlib.md5(raw + repr(sorted((added or {}).items())).encode()).hexdigest()
    if key not in _BUILT:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            lengths[rank] = len(piece)
        enc = tiktoken.Encoding(f"ranks-{key}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {})
        _BUILT[key] = enc, lengths
    return _BUILT[key]


def ordinary(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text without special tokens, however long its runs of white space are.

    The split pattern takes a run as one match, but for its last character where something follows, which is left to
    that. It looks back over the whole run to see this, and runs out of stack; so long runs are merged on their own.
    """
    out: list[int] = []
    at = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:])


def ids_of(enc: tiktoken.Encoding, text: str, named: bool = False) -> bytes:
    """Little-endian 32-bit ids of a text; names of special tokens are ordinary text unless `named`."""
    if not named or not enc.special_tokens_set:
        return np.array(ordinary(enc, text), "<u4").tobytes()
    names = sorted(enc.special_tokens_set, key=len, reverse=True)
    out: list[int] = []
    for piece in re.split(f"({'|'.join(map(re.escape, names))})", text):
        out += [enc.encode_single_token(piece)] if piece in enc.special_tokens_set else ordinary(enc, piece)
    return np.array(out, "<u4").tobytes()

"""Predictions, stored media and packings against restatements that share no code with the operators."""

import hashlib
import heapq
import io
import random
import wave
import zlib
from collections import Counter

from quillon.llm import op1_language, op5_media, op8_packing

SF = "/root/testdata/sf0.001"


def counted(text):
    """How often each run of one to three characters stands in the words of a text, edges of words being character 1."""
    out, word = Counter(), []
    for c in [*(text or "").lower(), " "]:
        if c.isalpha():
            word.append(ord(c))
        elif word:
            s = [1, *word, 1]
            out.update((x,) for x in word)
            out.update(zip(s, s[1:]))
            out.update(zip(s, s[1:], s[2:]))
            word = []
    return out


def order(grams, size):
    """The most frequent first; equal ones by their last character, then the one before."""
    return sorted(grams, key=lambda g: (-grams[g], [*[0] * (3 - len(g)), *g[::-1]]))[:size]


def test_every_prediction(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = {(r["text"], r["lang"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["text"] is not None and r["lang"] is not None}
    size = op1_language.PROFILE
    profiles = {}
    for lang in sorted({x for _, x in learned}):
        total = Counter()
        for t, x in sorted(learned):
            if x == lang:
                total.update(counted(t))
        profiles[lang] = {g: i for i, g in enumerate(order(total, size))}
    want = {}
    for r in rows:
        own = order(counted(r["text"]), size)
        if not own:
            want[r["doc_id"]] = ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        want[r["doc_id"]] = (best, round(1 - far[best] / (size * len(own)), 9))
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in op1_language.op1_language(spark, SF).collect()}
    assert got == want


def test_stored_form_is_a_wave_file(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        data = (r["text"] or "").encode()
        data += bytes(-len(data) % 64 or (0 if data else 64))
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(data)
        want[r["doc_id"]] = (len(held.getvalue()), hashlib.sha256(held.getvalue()).hexdigest(), f"wav:8bit:1ch:8000Hz:{len(data)}:[]")
    got = {r["doc_id"]: (r["media_bytes"], r["media_sha256"], r["feature"]) for r in op5_media.op5_media(spark, SF).collect()}
    assert got == want


def plain_assignment(lengths, size, quadratic):
    out, items, full = [], [], 0
    for k, n in enumerate(lengths):
        for j in range(n // size):
            out.append((k, j * size, size, full, 0))
            full += 1
        if n % size:
            items.append((-(n % size), k, n // size * size))
    heapq.heapify(items)
    open_ = [[0.0, 0] for _ in range(-(-sum(-x for x, _, _ in items) // size))]
    while items:
        left, k, start = heapq.heappop(items)
        n = -left
        fit = [s for s, (_, used) in enumerate(open_) if size - used >= n] or [s for s, (_, used) in enumerate(open_) if size > used]
        s = min(fit, key=lambda s: (open_[s][0], s))
        put = min(n, size - open_[s][1])
        out.append((k, start, put, full + s, open_[s][1]))
        open_[s][0] += put + quadratic * put * put
        open_[s][1] += put
        if put < n:
            heapq.heappush(items, (put - n, k, start + put))
    return out


def test_every_choice_of_a_sequence():
    r = random.Random(6)
    for size, most, n in ((16, 40, 300), (1024, 3000, 400), (64, 64, 500), (8, 1, 20)):
        lengths = [r.randint(1, most) for _ in range(n)]
        assert op8_packing.assign(lengths, size, 1 / size) == plain_assignment(lengths, size, 1 / size)

"""The queries that have no SQL, row by row against plain Python on whole small tables."""

import hashlib
import math
import re
import unicodedata

import pytest

from quillon.functions import metrics
from quillon.operators import clean, graph, route, search
from quillon.plans import registry

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_mmr(spark):
    vectors = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in table(spark, "embeddings")}
    size = {i: math.sqrt(sum(x * x for x in v)) for i, v in vectors.items()}
    cos = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b])) / (size[a] * size[b])
    want = {}
    for q in [i for i in vectors if i % 100 == 0]:
        left = sorted(vectors, key=lambda i: (-round(cos(q, i), 9), i))[:20]
        order = []
        while left and len(order) < 10:
            value = {i: round(0.7 * cos(q, i) - 0.3 * max((cos(i, j) for j in order), default=0.0), 9) for i in left}
            best = max(left, key=lambda i: value[i])
            want[q, len(order)] = (best, value[best])
            order.append(best)
            left.remove(best)
    got = {(r["query_id"], r["rank"]): (r["node_id"], r["score"]) for r in run(spark, "rerank_mmr")}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-9 for k in want)


def test_shingle_resemblance(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents")}
    questions = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id query_id", "text")
    nodes = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id node_id", "text content")
    lists = {}
    for r in search.bm25(questions, nodes, 20).collect():
        lists.setdefault(r["query_id"], []).append((r["rank"], r["node_id"], r["score"]))

    def shingles(text):
        w = re.findall(r"\w+", (text or "").lower())
        return {" ".join(w[i : i + 3]) for i in range(max(len(w) - 3, 0) + 1)}

    want = set()
    for q, hits in lists.items():
        kept = []
        for _, node, score in sorted(hits):
            s = shingles(texts[node])
            if all(len(s & t) / max(1, len(s | t)) < 0.5 for t in kept):
                want.add((q, node, score, len(kept)))
                kept.append(s)
    got = {(r["query_id"], r["node_id"], r["score"], r["rank"]) for r in run(spark, "rerank_shingles")}
    assert got == want and len(want) < sum(map(len, lists.values()))


def names_of(text, most):
    found = re.findall(rf"(?<!\w)[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){{0,{most - 1}}}(?!\w)", text)
    out = []
    for x in found:
        w = x.split()
        while w and w[0] in graph.OPENERS:
            w = w[1:]
        out += [" ".join(w)] if w else []
    return out


def test_name_subspans(spark):
    want = {}
    for r in table(spark, "conversations"):
        spans = {}
        for name in names_of(r["text"], 3):
            w = name.split()
            for a in range(len(w)):
                for b in range(a + 1, len(w) + 1):
                    spans.setdefault(" ".join(w[a:b]), len(spans))
        first = min(spans, key=lambda s: (-len(s.split()), spans[s]), default=None)
        want[r["conv_id"] * 1000 + r["turn"]] = (len(spans), first)
    assert {r["node_id"]: (r["spans"], r["longest"]) for r in run(spark, "name_subspans")} == want and any(n for n, _ in want.values())


def test_bootstrap():
    """Resampled means by plain loops over the same draws."""
    data = [0.25, 1.0, -0.5, 0.0, 0.75, 0.25, -1.0]
    n, resamples = len(data), 2000
    raw = hashlib.shake_256(",".join(repr(x) for x in data).encode()).digest(resamples * n * 5)
    draws = [int.from_bytes(raw[i : i + 4], "big") for i in range(0, len(raw), 4)]
    draws = [d % n for d in draws if d < (1 << 32) // n * n][: resamples * n]
    means = sorted(sum(data[d] for d in draws[i : i + n]) / n for i in range(0, len(draws), n))

    def quantile(p):
        at = p * (len(means) - 1)
        low = math.floor(at)
        return means[low] + (means[min(low + 1, len(means) - 1)] - means[low]) * (at - low)

    low, high = metrics.bootstrap_interval(data)
    assert (low, high) == (pytest.approx(quantile(0.025)), pytest.approx(quantile(0.975)))


def test_bootstrap_query(spark):
    rows = run(spark, "bootstrap")
    assert rows and all(r["low"] <= r["high"] for r in rows)


def test_clean_unicode(spark):
    want = {r["doc_id"]: hashlib.md5(unicodedata.normalize("NFC", r["text"]).encode()).hexdigest() for r in table(spark, "documents") if "Ã" not in r["text"] and "â€" not in r["text"]}
    got = {r["doc_id"]: r["digest"] for r in run(spark, "clean_unicode")}
    assert want and all(got[i] == d for i, d in want.items())


def test_clean_polish(spark):
    """Every word by itself: its longest-listed preposition off, unless it is a known word or too little remains."""
    plain = str.maketrans("ąćęłńóśźż", "acelnoszz")

    def parted(m):
        word = m[0]
        low = word.lower().translate(plain)
        if low in clean.WHOLE_WORDS:
            return word
        for p in clean.PREPOSITIONS:
            if low.startswith(p.translate(plain)) and len(word) - len(p) >= 3:
                return f"{word[: len(p)]} {word[len(p) :]}"
        return word

    want = {r["doc_id"]: hashlib.md5(re.sub(r"[^\W\d_]+", parted, r["text"]).encode()).hexdigest() for r in table(spark, "documents")}
    got = {r["doc_id"]: r["digest"] for r in run(spark, "clean_polish")}
    assert got == want


def test_rouge_longest(spark):
    def longest(a, b):
        above = [0] * (len(b) + 1)
        for x in a:
            own = [0]
            for j, y in enumerate(b):
                own.append(above[j] + 1 if x == y else max(above[j + 1], own[j]))
            above = own
        return above[-1]

    from quillon.plans import evaluation

    pairs = {(r["conv_id"], r["turn"]): (r["answer"], r["reference"]) for r in evaluation._pairs(spark, SF).collect()}
    for r in run(spark, "rouge_longest"):
        a, b = (re.findall(r"\w+", (x or "").lower()) for x in pairs[r["conv_id"], r["turn"]])
        same = longest(a, b)
        want = 0.0 if not same else 2 * same / (len(a) + len(b))
        assert abs(r["rouge_l"] - want) < 1e-6, (r, want)


def test_anchors_of_the_tables(spark):
    """The tables' texts are letters and line ends, so that no word is shaped like an identifier, and none is quoted."""
    words = {w for r in table(spark, "conversations") for w in r["text"].split()}
    shaped = [w for w in words if re.search(r"\d|[\"“`]|\w_\w|^[a-z]{2,}[A-Z][a-z]", w)]
    assert bool(run(spark, "query_anchors")) == bool(shaped)


def plain_anchors(text):
    """Quoted spans, then identifier-like tokens of what is left, by place, each text once."""
    found, rest = [], text
    for m in re.finditer(route.QUOTED, text):
        if inner := m[0][1:-1].strip(" "):
            found.append((m.start(), inner, "quoted"))
        rest = rest[: m.start()] + " " * len(m[0]) + rest[m.end() :]
    for m in re.finditer(r"[^ \t\n\x0b\f\r]+", rest):
        t = re.sub(f"^[{route.STRIP}]+|[{route.STRIP}]+$", "", m[0])
        mixed = re.search("[A-Za-z]", t) and re.search(r"[0-9]", t) and not re.search(r"(?i)^[0-9]+(st|nd|rd|th)$", t)
        number = re.search(r"^[0-9]{3,}$|^[0-9]+(\.[0-9]+)+$", t)
        shaped = mixed or number or re.search(r"[^\W_]_[^\W_]", t) or re.search(r"^[a-z]{2,}[A-Z][a-z]", t)
        if t and shaped and not re.search(r"(?i)^[0-9]+(\.[0-9]+)?\s?([kmgtp]i?b|[kmg]?hz|[kmg]?bps|[mµun]?s)$", t):
            found.append((m.start(), t, "identifier"))
    seen, out = set(), []
    for at, t, kind in sorted(found):
        if t not in seen:
            seen.add(t)
            out.append((at, t, kind))
    return out


def test_document_anchors(spark):
    want = {(r["doc_id"], *a) for r in table(spark, "documents") for a in plain_anchors(r["text"])}
    got = {(r["doc_id"], r["at"], r["text"], r["kind"]) for r in run(spark, "document_anchors")}
    assert got == want and "identifier" in {k for *_, k in want}

"""Signature join, manifest and prefix tries against plain restatements of their contracts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import op11_minhash, op12_merkle, op13_prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string, cls long, token string, key string"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, size):
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                name[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def texts():
    """Copies, near copies of several bases in chains and in groups that share half of their text, short and empty texts."""
    r = random.Random(5)
    out = [None, "", " \t\n", "one", "ONE", "two words", "three little words", "x" * 30_000, "日本語 é 🙂 z", "the same line " * 400]
    for base in range(4):
        words = [f"w{r.randint(0, 900)}" for _ in range(r.choice([60, 200, 400]))]
        for k in range(30):
            copy = list(words)
            for _ in range(r.randint(0, len(words) // 18)):
                copy[r.randrange(len(copy))] = f"e{r.randint(0, 10**6)}"
            out.append(" ".join(copy))
            if k % 10 == 0:
                words = copy
    shared = [f"s{i}" for i in range(80)]
    out += [" ".join(shared + [f"own{i}x{j}" for j in range(40)]) for i in range(40)]
    out += [out[20].upper(), out[20], out[20]]
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    t = texts()
    ids = r.sample(range(-50, 4000), len(t))
    return [*zip(ids, t), (ids[30], t[30]), (ids[30], t[30]), (None, t[40]), (None, "nobody's own text is this"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, [None, "", "en", "de", "zß"][k % 5], None if k % 3 else "s", None if k % 7 == 0 else k, "d", "t", k, "tok", "key") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(6)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_minhash(docs, rows, size, percent):
    got = op11_minhash.near_duplicates(docs, shingle=size, percent=percent)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == brute_components(rows, size, percent)
    assert op11_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_no_link_between_groups_is_lost(spark, monkeypatch):
    """Lists of any length, one leader or many: what is linked with a group's last member only is still found."""
    monkeypatch.setattr(op11_minhash, "LONG", 2)
    monkeypatch.setattr(op11_minhash, "SERVED", 3)
    r = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows, word = [], list(base)
    for k in range(60):
        for _ in range(2):
            word[r.randrange(100)] = f"e{k}x{r.randint(0, 9999)}"
        rows.append((k, " ".join(word)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = op11_minhash.near_duplicates(docs, shingle=3, percent=85, matches=32)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows, 3, 85)


def test_signatures_collide_as_often_as_sets_are_alike():
    r = np.random.Generator(np.random.PCG64(3))
    n, spread = 200, []
    for shared in (600, 850, 950):
        counts = []
        for _ in range(n):
            every = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
            own = (1000 - shared) // 2
            a, b = every[: shared + own], np.concatenate((every[:shared], every[shared + own :]))
            s = op11_minhash.signatures([a, b])
            counts.append(int((s[0] == s[1]).sum()))
        j = shared / 1000
        assert abs(np.mean(counts) - 64 * j) < 5 * (64 * j * (1 - j) / n) ** 0.5
        spread.append(np.var(counts) / (64 * j * (1 - j)))
        assert min(counts) >= (32 if shared >= 850 else 0)
    assert max(spread) < 1.6


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted rows of op12's contract."""

    def told(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    trees = defaultdict(list)
    for x in rows:
        trees["" if x[2] is None else "=" + x[2]].append((x[0] is not None, x[0] or 0, h(*map(told, x)), x))
    names = sorted(trees, key=lambda n: n.encode())
    low = {}
    for n in names:
        trees[n].sort(key=lambda x: x[:3])
        low[n] = climb([x[2] for x in trees[n]])
    high = climb([low[n][-1][0] for n in names])
    out = []
    for t, n in enumerate(names):
        for k, (_, _, leaf, x) in enumerate(trees[n]):
            changed = list(x)
            if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 7 == 0 and x[3] is not None:
                changed[3] += 1
            digest, proof = h(*map(told, changed)), []
            for at, levels in ((k, low[n]), (t, high)):
                for nodes in levels[:-1]:
                    run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += [v for i, v in enumerate(run) if i != at % 2]
                    run[at % 2] = digest
                    digest, at = h(*run), at // 2
            out.append((x[0], leaf, low[n][-1][0], high[-1][0], h(*proof), digest, digest == high[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 3, 12])
def test_manifest(docs, height):
    more = op12_merkle.leaf([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in op12_merkle.FIELDS])
    found = op12_merkle.manifest(docs, tampered=F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, more), height=height)
    got = found.select("id", "leaf", "subroot", "root", F.sha2(op12_merkle.proof_text(F.col("proof")), 256), "folded_root", "verified")
    want = brute_manifest([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_none_and_of_one(docs):
    assert op12_merkle.manifest(docs.limit(0)).count() == 0
    (one,) = op12_merkle.manifest(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(1)).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and not one["proof"]


def test_any_change_breaks_the_proof(docs):
    """A changed digest, place or sibling folds to another root."""
    siblings = [bytes([i]) * 32 for i in range(4)]
    root = op12_merkle.folded(b"x" * 32, 5, 13, siblings)
    assert root != op12_merkle.folded(b"y" * 32, 5, 13, siblings)
    assert root != op12_merkle.folded(b"x" * 32, 4, 13, siblings)
    assert root != op12_merkle.folded(b"x" * 32, 5, 13, siblings[::-1])


CONV = "conv_id long, turn long, role string, text string, path string, depth long, key string, seq string, base long"


def brute_trie(turns):
    """turns: (conv_id, turn, role, text) -> sorted rows of op13's contract."""
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    nodes = defaultdict(list)
    whole = {}
    for c, t in own.items():
        n = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:n]) + tuple(t[n:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        ends = sorted(c for c in members if whole[c] == path)
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), len(leaves),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations():
    r = random.Random(8)
    out = []
    for c in [*range(0, 60), *range(-8, 0), *range(100, 130), *range(301, 340), 10**12]:
        for k in range(r.choice([1, 2, 2, 3, 6, 12])):
            out.append((c, r.choice([k, k, None]), r.choice(["user", "assistant", None, ""]), r.choice(["hi", "Hello é", "🙂", None, "", "a longer text", str(r.randint(0, 3))])))
    out += [(c, k, "user", f"the same {k}") for c in range(500, 560) for k in range(9)]
    out += [out[3], out[3], (None, 1, "user", "of nobody"), (None, None, None, None)]
    return out


@pytest.mark.parametrize("per_shard,fan", [(200_000, 64), (10, 2), (25, 3)])
def test_prefix_trie(spark, per_shard, fan):
    rows = conversations()
    turns = spark.createDataFrame([(*x, "p", 3, "k", "s", 4) for x in rows], CONV).repartition(5)
    lists = op13_prefix_trie.rebuilt(op13_prefix_trie.turn_lists(turns))
    got = op13_prefix_trie.prefix_nodes(op13_prefix_trie.paths_of(lists), per_shard=per_shard, fan=fan)
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == brute_trie(rows)
    none = op13_prefix_trie.paths_of(op13_prefix_trie.turn_lists(turns.limit(0)))
    assert op13_prefix_trie.prefix_nodes(none).count() == 0


def test_members_of_one_node_fill_many_shards(spark, monkeypatch):
    """Equal conversations over many shards and rows of ids are one path; their ids are hashed in order."""
    monkeypatch.setattr(op13_prefix_trie, "IDS", 7)
    paths = spark.range(0, 300).selectExpr("id as conv_id", "unhex(repeat('ab', 32)) as path", "array(4, 5) as chars")
    got = {r["depth"]: r for r in op13_prefix_trie.prefix_nodes(paths, per_shard=20, fan=2).collect()}
    assert sorted(got) == [0, 1, 2] and all(r["n_convs"] == 300 and r["n_leaves"] == 1 and r["conv_id"] == 0 for r in got.values())
    assert got[2]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()
    assert [got[d]["saved_tokens"] for d in range(3)] == [299 * 9, 299 * 9, 299 * 5]


def test_louds():
    """Bits and labels alone lead from the root along paths and back to parents."""
    paths = [[], [b"a"], [b"a", b"b"], [b"a", b"c", b"d"], [b"b"], [b"b", b"a"]]
    marks = np.array([x * 16 for p in paths for x in p], "S16")
    trie, depth, _, ends = op13_prefix_trie.trie_of(marks, np.array([len(p) for p in paths]))
    assert depth.tolist() == [0, 1, 1, 2, 2, 2, 3] and trie.degrees().tolist() == [2, 2, 1, 0, 1, 0, 0] and trie.parents().tolist() == [-1, 0, 0, 1, 1, 2, 4]
    assert "".join(map(str, np.unpackbits(trie.bits)[:15].tolist())) == "101101101001000"
    assert [trie.walk(np.array([x * 16 for x in p], "S16"))[-1] for p in paths] == ends.tolist()
    assert trie.walk(np.array([b"a" * 16, b"z" * 16], "S16")) == [0, 1]


@pytest.mark.parametrize("number", [0, 7, 10**12, -5, 123456789])
def test_crc32_in_sql(number):
    assert duckdb.sql(f"SELECT {op12_merkle.crc32_sql(str(number))}").fetchall() == [(zlib.crc32(str(number).encode()),)]


def test_components_of_a_batch_without_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, op11_minhash.near_duplicates(docs).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]

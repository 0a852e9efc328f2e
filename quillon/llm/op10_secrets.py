"""Secret scans: base formats, and further ones recognised by automata inferred from labelled credentials."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.session import table

#: The base formats, in their order.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
#: What the automata score: words of credential characters as long as the shortest labelled value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Documents that labelled credentials are taken from, about; and credentials of each kind, at most.
LABELLED_DOCUMENTS, LABELLED_EACH = 20_000, 400
#: Symbols of all words that an automaton learns from, at most; a word is learned from whole or not at all.
SYMBOLS = 200_000


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base formats, leftmost non-overlapping within each kind, failing matches dropped."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


_CLASS = {c: "d" for c in "0123456789"} | {c: "a" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEF"} | {c: "L" for c in "GHIJKLMNOPQRSTUVWXYZ"}


_COARSE = str.maketrans({c: "x" for c in "alAL"})


def symbols(word: str) -> str:
    """A word's characters as classes: digits, hexadecimal and other letters of either case, signs as themselves."""
    return "".join(_CLASS.get(c, c) for c in word)


def coarse(symbols: str) -> str:
    """Classes without the kind of letter: credentials of a labelled make whose letters are of another case or range."""
    return symbols.translate(_COARSE)


class Automaton:
    """A probabilistic automaton merged from the prefix tree of sample words (compatibility by Hoeffding's bound)."""

    def __init__(self, words: Iterable[str], alpha: float = 0.05, floor: float = 1e-3) -> None:
        self.floor = floor
        self.go: list[dict[str, int]] = [{}]
        self.n: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]
        for w in words:
            s = 0
            for c in w:
                self.n[s][c] = self.n[s].get(c, 0) + 1
                if c not in self.go[s]:
                    self.go[s][c] = len(self.go)
                    self.go.append({})
                    self.n.append({})
                    self.end.append(0)
                s = self.go[s][c]
            self.end[s] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _total(self, s: int) -> int:
        return self.end[s] + sum(self.n[s].values())

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states' futures are statistically compatible, on the pairs they lead to as well."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            x, y = self._total(a), self._total(b)
            if not x or not y:
                continue
            gap = self._bound * (1 / math.sqrt(x) + 1 / math.sqrt(y))
            if abs(self.end[a] / x - self.end[b] / y) >= gap:
                return False
            for c in self.n[a].keys() | self.n[b].keys():
                if abs(self.n[a].get(c, 0) / x - self.n[b].get(c, 0) / y) >= gap:
                    return False
                if c in self.go[a] and c in self.go[b]:
                    todo.append((self.go[a][c], self.go[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.end[a] += self.end[b]
            for c, k in self.n[b].items():
                self.n[a][c] = self.n[a].get(c, 0) + k
                if c in self.go[a]:
                    todo.append((self.go[a][c], self.go[b][c]))
                else:
                    self.go[a][c] = self.go[b][c]

    def _merge(self) -> None:
        red = {0: None}
        while blue := next(((s, c) for s in red for c in sorted(self.go[s]) if self.go[s][c] not in red), None):
            s, c = blue
            t = self.go[s][c]
            into = next((r for r in red if self._alike(r, t)), None)
            if into is None:
                red[t] = None
            else:
                self.go[s][c] = into
                self._fold(into, t)
        self.logs = {s: {c: math.log(k / self._total(s)) for c, k in self.n[s].items()} for s in red}
        self.ends = {s: math.log(self.end[s] / self._total(s)) for s in red if self.end[s]}
        self.go = {s: self.go[s] for s in red}
        del self.n, self.end

    def likelihood(self, word: str) -> float:
        """Mean log probability of a word's symbols and its end; what is unseen in its state costs the floor, and a symbol
        goes back to the start."""
        total, s, low = 0.0, 0, math.log(self.floor)
        for c in word:
            p = self.logs.get(s, {}).get(c)
            total += low if p is None else p
            s = 0 if p is None else self.go[s][c]
        return (total + self.ends.get(s, low)) / (len(word) + 1)


def _bounded(words: list[str]) -> list[str]:
    """The words in order, without those that would take the symbols of all beyond SYMBOLS."""
    out, held = [], 0
    for w in words:
        if held + len(w) <= SYMBOLS:
            out.append(w)
            held += len(w)
    return out


class Formats:
    """For each labelled kind automata of its fine and of its coarse symbols, likewise for ordinary words; of each kind
    the least likelihood and the least length."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str], margin: float = 0.2) -> None:
        self.margin = margin
        self.views = []
        for view in (str, coarse):
            usual = Automaton(_bounded(sorted(map(view, ordinary))), alpha=0.2) if len(ordinary) >= 20 else None
            kinds = []
            for kind in sorted(labelled):
                words = _bounded(sorted(map(view, labelled[kind])))
                if len(words) >= 20:
                    a = Automaton(words)
                    kinds.append((a, sorted(map(a.likelihood, words))[len(words) // 50], min(map(len, words))))
            self.views.append((view, usual, kinds))

    def secret(self, word: str) -> bool:
        """Whether a word is as long and as likely as 49 of 50 credentials of some kind, and likelier so than as an
        ordinary word, by its fine or by its coarse symbols."""
        fine = symbols(word)
        for view, usual, kinds in self.views:
            w = view(fine)
            likely = [x for a, least, shortest in kinds if len(w) >= shortest and (x := a.likelihood(w)) >= least]
            if likely and max(likely) - (usual.likelihood(w) if usual else -math.inf) >= self.margin:
                return True
        return False


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", documents: int = LABELLED_DOCUMENTS, each: int = LABELLED_EACH) -> Formats:
    """Formats inferred from the base credentials and the ordinary words of about `documents` documents.

    The sample is chosen by a hash of id and text length; of each kind of credential, and of ordinary words, the
    `each` first by a hash count, wherever they stand in the sampled texts and however rows are dealt to tasks.
    """
    n = docs.count()
    part = min(1.0, documents / max(1, n)) * (1 << 30)
    chosen = docs.where(F.col(text_col).isNotNull()).where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)), F.lit(1 << 30)) < part)

    def first(words: set[str]) -> set[str]:
        return set(heapq.nsmallest(each, words, key=lambda w: hashlib.md5(w.encode()).hexdigest()))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, set[str]] = {kind: set() for kind in ("", *KINDS[:3])}
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py()
                for start, kind, end in base_spans(text):
                    word = text[start:end]
                    held[kind].add(ASSIGN.match(word)[2] if kind == "assign" else word)
                held[""].update(w for w in re.findall(r"[A-Za-z0-9+/_.=-]{5,}", text) if not HEX.search(w))
                for kind, words in held.items():
                    if len(words) > 50 * each:
                        held[kind] = first(words)
        rows = [(kind, w) for kind, words in held.items() for w in first(words)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())], names=["kind", "word"])

    order = Window.partitionBy("kind").orderBy(F.md5("word"))
    words = chosen.select(text_col).mapInArrow(label, "kind string, word string").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    by: dict[str, list[str]] = {}
    for r in sorted(words.select("kind", "rank", "word").collect()):
        by.setdefault(r["kind"], []).append(symbols(r["word"]))
    return Formats({k: v for k, v in by.items() if k}, by.get("", []))


def spans(text: str | None, formats: Formats) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, spans that the automata add), each by start, then kind; added ones touch no base span."""
    if not text:
        return [], []
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[1])))
    more = []
    k = top = 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            top = max(top, base[k][2])
            k += 1
        if top <= m.start() and formats.secret(m[0]):
            more.append((m.start(), "format", m.end()))
    return base, more


def _joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


def scan(docs: DataFrame, formats: Formats, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format) of every whole text.

    Offsets are code points, ends exclusive. A null or empty text has no spans (the hash is that of ''). Rows are
    scanned on their own: repeated rows alike, null ids kept, other columns left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(formats)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, more = spans(x.as_py(), sent.value)
                n = Counter(kind for _, kind, _ in base)
                everything = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))
                rows.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(everything), len(more)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


def redact(docs: DataFrame, formats: Formats, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows and columns of docs, with every span in the text replaced by a mark; overlapping spans by one."""
    sent = docs.sparkSession.sparkContext.broadcast(formats)
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        base, more = spans(text, sent.value)
        if not base and not more:
            return text
        out, end = [], 0
        for start, _, stop in sorted(base + more):
            if start >= end:
                out += [text[end:start], mark]
            end = max(end, stop)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(x.as_py()) for x in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced by a mark in the text; every document stays, other columns unchanged.

    Formats are inferred from the stage's own input.
    """
    return redact(docs, fit(docs))

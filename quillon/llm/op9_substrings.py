"""Substring deduplication by automata of recurring phrases.

Phrases that recur in the corpus are confirmed by exact counts. Blocks of documents are the shards: the confirmed
phrases of a block are compiled into Aho-Corasick automata, all its documents are streamed through them, and only
where the automata find a phrase are windows compared. So an automaton is as large as its block, whatever the corpus
has of recurring phrases, and no document is sent to another shard. Each window is known by the phrase in it with the
least hash; equal windows have the same and meet under it, where 64-bit hashes tell which came first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.words import hashed, runs, sliced, text_bytes
from quillon.session import table

#: Bits of the filter of recurring phrases: 16 MB, whatever the corpus. A full filter only costs shuffled bytes.
FILTER_BITS = 27
#: Documents whose candidates share a shard, about.
PER_SHARD = 2000
#: Documents whose windows a task holds at once.
AT_ONCE = 4000
#: Bytes of the documents that share automata, about, and phrases in an automaton (some 50 MB).
BLOCK_BYTES, AUTOMATON = 1 << 20, 10_000
_SEGMENT = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("windows", "u1")])
_MARK = np.dtype([("start", "<i4"), ("mask", "<u4")])
_NULL_ID = -(1 << 63)


class Window:
    """Windows of `width` words, and the phrase of half as many by which each is found.

    The phrase of a window is that of its phrases with the least hash (the first on ties). It depends on the
    window's words alone, so equal windows have equal phrases, wherever they stand.
    """

    def __init__(self, width: int) -> None:
        self.width, self.phrase = width, max(1, width // 2)
        self.inside = width - self.phrase + 1

    def anchors(self, phrases: np.ndarray) -> np.ndarray:
        """Position of the phrase of each window; never decreasing."""
        n = len(phrases) - self.inside + 1
        return np.lib.stride_tricks.sliding_window_view(phrases, self.inside).argmin(axis=1) + np.arange(n)


def _per_document(batch: pa.RecordBatch, w: Window) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, word hashes, phrase hashes, phrase position of each window) of the texts with a window."""
    h, first = hashed(*text_bytes(batch.column("text")))
    phrases = runs(h, w.phrase)
    for row in np.flatnonzero(np.diff(first) >= w.width):
        a, b = int(first[row]), int(first[row + 1])
        own = phrases[a : b - w.phrase + 1]
        yield int(row), h[a:b], own, w.anchors(own)


def compiled(phrases: list[str], most: int = AUTOMATON) -> Iterator[ahocorasick.Automaton]:
    """Automata of at most so many phrases, one at a time; a phrase is told from parts of words by spaces around it."""
    for a in range(0, len(phrases), most):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases[a : a + most]:
            automaton.add_word(f" {p} ")
        automaton.make_automaton()
        yield automaton


def occurrences(texts: list[list[str]], phrases: list[str], words: int, most: int = AUTOMATON) -> list[np.ndarray]:
    """For each text (a list of words), whether a phrase of so many words begins at each word, by the automata alone."""
    found = [np.zeros(len(t), bool) for t in texts]
    ends: list[np.ndarray] = []
    for automaton in compiled(phrases, most):
        for k, t in enumerate(texts):
            if k == len(ends):
                ends.append(np.cumsum(np.fromiter(map(len, t), np.int64, len(t)) + 1))
            hits = np.fromiter((end for end, _ in automaton.iter(f" {' '.join(t)} ")), np.int64)
            found[k][np.searchsorted(ends[k], hits) - (words - 1)] = True
    return found


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about BLOCK_BYTES; a longer document is a block of its own."""
    at = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > BLOCK_BYTES:
            yield at, k
            at, held = k, 0
        held += size
    if held:
        yield at, len(sizes)


def _located(batch: pa.RecordBatch, w: Window, known: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What `_per_document` gives, and at which words the automata of the document's block find a phrase."""
    column = batch.column("text")
    items = list(_per_document(batch, w))
    data = [column[row].as_buffer() for row, *_ in items]
    for a, b in _blocks([len(d) for d in data]):
        texts = [[x.decode() for x in d.to_pybytes().split()] for d in data[a:b]]
        phrases: dict[int, str] = {}
        for words, (_, _, own, at) in zip(texts, items[a:b]):
            places = at[np.concatenate(([True], at[1:] != at[:-1]))]
            bit = own[places] >> np.uint64(64 - bits)
            confirmed = (known[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1
            for p in places[confirmed == 1].tolist():
                if (key := int(own[p])) not in phrases:
                    phrases[key] = " ".join(words[p : p + w.phrase])
        if phrases:
            for item, found in zip(items[a:b], occurrences(texts, list(phrases.values()), w.phrase)):
                yield *item, found


def _recurring(docs: DataFrame, w: Window, shards: int, bits: int) -> bytes:
    """A bitmap by the leading bits of their hashes of the phrases that occur more than once."""
    edges = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own[np.unique(at)] for _, _, own, at in _per_document(batch, w)]
            if found:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                cut = [0, *np.searchsorted(values, edges).tolist(), len(values)]
                rows = [(k, values[a:b][n[a:b] == 1].tobytes(), values[a:b][n[a:b] > 1].tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["shard", "once", "more"])

    def confirm(t: pa.Table) -> pa.Table:
        once, more = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64) for c in ("once", "more"))
        values, n = np.unique(once, return_counts=True)
        at = np.unique(np.concatenate((values[n > 1], more)) >> np.uint64(64 - bits)).astype(np.uint32)
        return pa.table({"at": pa.array([at.tobytes()], pa.binary())})

    bitmap = np.zeros(1 << bits, bool)
    parts = docs.select("text").mapInArrow(phrases, "shard int, once binary, more binary").groupBy("shard").applyInArrow(confirm, "at binary")
    for row in parts.toLocalIterator():
        bitmap[np.frombuffer(row["at"], np.uint32)] = True
    return np.packbits(bitmap).tobytes()


def _first(value: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each occurrence is, of its value, at the least (doc, start); several rows may be there."""
    order = np.lexsort((start, doc, value))
    v, d, s = value[order], doc[order], start[order]
    head = np.concatenate(([True], v[1:] != v[:-1]))
    lead = np.maximum.accumulate(np.where(head, np.arange(len(v)), 0))
    out = np.empty(len(v), bool)
    out[order] = (d == d[lead]) & (s == s[lead])
    return out


def _masks(flags: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Flags of consecutive windows as one number a segment, the first window in the lowest bit."""
    at = np.cumsum(count) - count
    place = np.arange(len(flags)) - np.repeat(at, count)
    return np.add.reduceat(flags.astype(np.uint32) << place.astype(np.uint32), at) if len(count) else np.empty(0, np.uint32)


def _marked(doc: np.ndarray, text: np.ndarray, start: np.ndarray, mask: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(doc, text, marks) by document of the segments with a repeated window."""
    keep = np.flatnonzero(mask)
    keep = keep[np.lexsort((start[keep], text[keep], doc[keep]))]
    doc, text = doc[keep], text[keep]
    marks = np.empty(len(keep), _MARK)
    marks["start"], marks["mask"] = start[keep], mask[keep]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (text[1:] != text[:-1])) + 1
    edge = [0, *cut.tolist(), len(keep)] if len(keep) else []
    return [(int(doc[a]), int(text[a]), marks[a:b].tobytes()) for a, b in zip(edge, edge[1:])]


_ROW = pa.schema([("shard", pa.int32()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("head", pa.binary()), ("windows", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW)


def repeats(docs: DataFrame, *, width: int = 20, bits: int = FILTER_BITS, per_shard: int = PER_SHARD) -> DataFrame:
    """(doc, text_hash, marks): where windows of `width` words stand that also start earlier.

    docs has (doc, text). Three passes: phrases that occur more than once are counted exactly, by hash, and set in
    a filter of fixed size; automata find these phrases in all documents, and the windows around them go, as 64-bit
    hashes of their words, to the shard of the phrase; there each window's first occurrence is told from the later ones. Two windows that differ in one word
    are taken for equal only if that word's 64-bit hashes are (2**-64 a pair). Of equal windows among AT_ONCE
    documents a task sends on only the first, for the later ones are repeated in any case: a passage in a third of
    all documents reaches its shard once for so many.
    """
    spark, w = docs.sparkSession, Window(width)
    shards = max(16, docs.count() // per_shard)
    flags = spark.sparkContext.broadcast(_recurring(docs, w, shards, bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(flags.value, np.uint8)
        for batch in sliced(batches, AT_ONCE):
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            heads, windows, phrase = [], [], []
            for row, h, own, at, found in _located(batch, w, known, bits):
                begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                count = np.diff(np.append(begin, len(at)))
                chosen = np.flatnonzero(found[at[begin]])
                if not len(chosen):
                    continue
                begin, count = begin[chosen], count[chosen]
                head = np.empty(len(begin), _SEGMENT)
                head["doc"], head["text"] = ids[row], np.uint64(xxhash.xxh3_64_intdigest(batch.column("text")[row].as_py().encode())).astype(np.int64)
                head["start"], head["windows"] = begin, count
                heads.append(head)
                phrase.append(own[at[begin]])
                all_windows = runs(h, width)
                windows += [all_windows[a : a + n] for a, n in zip(begin.tolist(), count.tolist())]
            if not heads:
                continue
            head, phrase, value = np.concatenate(heads), np.concatenate(phrase), np.concatenate(windows)
            count = head["windows"].astype(np.int64)
            start = np.repeat(head["start"].astype(np.int64), count) + np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count)
            late = ~_first(value, np.repeat(head["doc"], count), start)
            mask = _masks(late, count)
            rows = [(doc % shards, doc, text, marks, None) for doc, text, marks in _marked(head["doc"], head["text"], head["start"], mask)]
            send = np.flatnonzero(mask != (1 << count) - 1)
            shard = ((phrase[send] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            order = send[np.argsort(shard, kind="stable")]
            shard = np.sort(shard, kind="stable")
            cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(order)] if len(order) else []
            for a, b in zip(cut, cut[1:]):
                rows.append((int(shard[a]), None, None, head[order[a:b]].tobytes(), np.concatenate([windows[i] for i in order[a:b].tolist()]).tobytes()))
            for a in range(0, len(rows), 5000):
                yield _rows(rows[a : a + 5000])

    def resolve(t: pa.Table) -> pa.Table:
        done = t.filter(pa.compute.is_valid(t.column("doc")))
        out = list(zip(done.column("doc").to_pylist(), done.column("text_hash").to_pylist(), done.column("head").to_pylist()))
        sent = t.filter(pa.compute.is_null(t.column("doc")))
        head = np.frombuffer(b"".join(sent.column("head").to_pylist()), _SEGMENT)
        if len(head):
            value = np.frombuffer(b"".join(sent.column("windows").to_pylist()), np.uint64)
            count = head["windows"].astype(np.int64)
            start = np.repeat(head["start"].astype(np.int64), count) + np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count)
            late = ~_first(value, np.repeat(head["doc"], count), start)
            out += _marked(head["doc"], head["text"], head["start"], _masks(late, count))
        doc, text, marks = zip(*out) if out else ((), (), ())
        return pa.table({"doc": pa.array(doc, pa.int64()), "text_hash": pa.array(text, pa.int64()), "marks": pa.array(marks, pa.binary())})

    schema = "shard int, doc long, text_hash long, head binary, windows binary"
    return docs.mapInArrow(candidates, schema).groupBy("shard").applyInArrow(resolve, "doc long, text_hash long, marks binary")


def covered(n: int, marks: list[bytes], width: int) -> np.ndarray:
    """Which of n words the marked windows cover."""
    step = np.zeros(n + 1, np.int32)
    m = np.frombuffer(b"".join(marks), _MARK)
    for bit in range(32):
        s = m["start"][(m["mask"] >> np.uint32(bit)) & 1 == 1] + bit
        np.add.at(step, s, 1)
        np.add.at(step, np.minimum(s + width, n), -1)
    return np.cumsum(step[:n]) > 0


def _with_marks(rows: DataFrame, width: int) -> DataFrame:
    """rows, which are (id, text, own), with `texts`: marks by text hash, null where nothing is repeated.

    `own` holds what else a row has, as one struct, so that its names cannot clash with these.
    """
    base = rows.withColumn("doc", F.coalesce("id", F.lit(_NULL_ID)))
    marks = repeats(base.select("doc", F.coalesce("text", F.lit("")).alias("text")), width=width)
    marks = marks.groupBy("doc", "text_hash").agg(F.collect_list("marks").alias("marks")).groupBy("doc").agg(F.collect_list(F.struct("text_hash", "marks")).alias("texts"))
    return base.join(marks, "doc", "left").select("id", "text", "own", "texts")


def _flags(text: str | None, texts, width: int) -> tuple[list[bytes], np.ndarray | None]:
    """(words, which of them to remove or None) of a text."""
    data = (text or "").encode()
    words = data.split()
    if texts:
        own = int(np.uint64(xxhash.xxh3_64_intdigest(data)).astype(np.int64))
        for x in texts:
            if x["text_hash"] == own:
                return words, covered(len(words), x["marks"], width)
    return words, None


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) after every repeated window of `width` words is removed.

    A window is repeated if its words also start earlier: in a document of smaller id, or earlier in one of the
    same id. Windows are judged on the input. A null id is below all others; a null text has no words; rows with
    equal id and text are the same document and keep the same words. Other columns are left out.
    """
    rows = _with_marks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).alias("own")), width)
    names, types = ["doc_id", "n_words", "n_removed", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, texts in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("texts")):
                words, gone = _flags(text.as_py(), texts.as_py(), width)
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.select("id", "text", "texts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 20 words that stand earlier in the corpus."""
    return digests(table(spark, sf_dir, "documents"))


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """The rows and columns of docs with repeated windows cut out of the text; untouched texts stay as they are.

    Where words go, the rest are joined by one space; a text that loses all its words becomes empty.
    """
    names = docs.columns
    at = names.index(text_col)
    others = [F.col(f"`{n}`") for n in names if n != text_col]
    own = F.struct(*others) if others else F.lit(0)
    rows = _with_marks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), own.alias("own")), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, texts in zip(batch.column("text"), batch.column("texts")):
                words, gone = _flags(text.as_py(), texts.as_py(), width) if texts.is_valid else (None, None)
                new.append(text.as_py() if gone is None or not gone.any() else b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            columns = batch.column("own").flatten() if len(names) > 1 else []
            columns.insert(at, pa.array(new, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages of 20 words or more that stand earlier in the corpus are cut; every row stays."""
    return remove(docs)


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
each AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM w WHERE len(w) >= 20),
keyed AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM windows),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, min((doc_id, s)) OVER (PARTITION BY k) AS first FROM keyed) WHERE (doc_id, s) > first),
gone AS (SELECT DISTINCT doc_id, s + j AS i FROM late, range(20) r(j)),
told AS (SELECT each.doc_id, each.word, each.i, gone.i IS NOT NULL AS out FROM each LEFT JOIN gone USING (doc_id, i))
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(t.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count_if(out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT out) AS kept FROM told GROUP BY doc_id) t USING (doc_id)
"""

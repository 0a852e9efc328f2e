"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.words import unused
from quillon.session import table

#: Documents per language that profiles are fitted on, about; chosen by a hash of the id.
PER_LANGUAGE = 2000
#: Most frequent n-grams in a profile.
PROFILE = 300
#: Least score that the pipeline keeps: below it a text's n-grams are, in the mean, out of place by nine tenths of a
#: profile, or in no profile, so it is in none of the learned languages.
LEAST = 0.1
#: More labels than this are refused: profiles are broadcast.
MAX_LANGUAGES = 2000

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes, counts), by code, of one to three characters of a text's lower-cased words.

    A word is a run of letters between two edge marks (1). An n-gram is 21 bits a character, never crosses words,
    and is never an edge mark alone.
    """
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _letters()[c]
    if not word.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    before = np.concatenate(([False], word[:-1]))
    keep = word | before
    c = np.where(word, c, 1)[keep].astype(np.uint64)
    c = np.concatenate((np.array([1], np.uint64), c, np.array([1], np.uint64)))
    two = c[:-1] | (c[1:] << np.uint64(21))
    three = two[:-1] | (c[2:] << np.uint64(42))
    edge = c == 1
    codes = np.concatenate((c[~edge], two[~(edge[:-1] & edge[1:])], three[~edge[1:-1]]))
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, the most frequent first; ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Ranks of n-grams by language; languages are in alphabetical order, which decides ties."""

    def __init__(self, by_language: dict[str, list[int]], size: int) -> None:
        self.size = size
        self.names = sorted(by_language)
        self.codes = np.array(sorted({g for x in by_language.values() for g in x}), np.uint64)
        self.ranks = np.full((len(self.codes), len(self.names)), size, np.int32)
        for j, name in enumerate(self.names):
            at = np.searchsorted(self.codes, np.array(by_language[name], np.uint64))
            self.ranks[at, j] = np.arange(len(at))
        self.known = self.ranks < size

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 less the mean out-of-place distance in units of the profile's size); ("und", 0) without a letter."""
        codes, counts = grams(text)
        if not len(codes) or not self.names:
            return "und", 0.0
        mine = ranked(codes, counts, self.size)
        if not len(self.codes):
            return self.names[0], 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        found = np.flatnonzero(self.codes[at] == mine)
        at = at[found]
        far = np.where(self.known[at], np.abs(self.ranks[at] - found[:, None]), self.size)
        total = far.sum(axis=0) + self.size * (len(mine) - len(found))
        best = int(np.argmin(total))
        return self.names[best], float(1 - total[best] / (self.size * len(mine)))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, size: int = PROFILE) -> Profiles:
    """Profiles from about `per_language` distinct texts of each language, all of them where it has fewer.

    Rows without text or language are left out. More than MAX_LANGUAGES labels are refused.
    """
    known = labelled.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    many = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(many) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    if not many:
        return Profiles({}, size)
    part = F.create_map(*[F.lit(x) for r in many for x in (r["lang"], min(1.0, per_language / r["count"]))])
    chosen = known.where("text is not null").where(F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(1 << 30)) < part[F.col("lang")] * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text.as_py()))
            for lang, found in by.items():
                codes, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([y for _, y in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counted = chosen.select("text", "lang").dropDuplicates().mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "rank", "code").collect()
    by_language: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        by_language.setdefault(r["lang"], []).append(r["code"])
    return Profiles(by_language, size)


def predict(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, then the predicted language and its score, from the whole text alone.

    A null text, or one without a letter, is "und" with score 0; so is every text where nothing was learned.
    Columns of docs with the two names given are replaced. Repeated rows are predicted alike; equal distances go to
    the language first in the alphabet.
    """
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            found = [p.predict(x.as_py()) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0. A null id counts as ''."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those that are not held out."""
    profiles = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(spark, table(spark, sf_dir, "documents"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can be told stay, with their own columns.

    Rejected are texts that are null, hold no letter, or score less than LEAST against every profile. Where no
    document is labelled nothing can be told apart and only texts without letters go.
    """
    profiles = fit(docs.where(~held_out()))
    if profiles.names:
        names = unused("language", docs), unused("score", docs)
        return predict(docs, profiles, names=names).where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.where(F.col("text").rlike(r"\p{L}"))

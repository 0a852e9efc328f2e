"""Cleaners: a node's text to a cleaner text. Each is a column expression, so cleaners fuse into one stage."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.identity import node_id


def whitespace(text: Column) -> Column:
    """One space for runs of blanks, none before a newline, at most one empty line, none at the ends."""
    x = F.regexp_replace(text, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" +\n", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def hyphenation(text: Column) -> Column:
    """Join words that a line break split at a hyphen."""
    return F.regexp_replace(text, r"(?U)(\w+)-[ \t]*\n[ \t]*(\w+)", "$1$2")


def artifacts(text: Column) -> Column:
    """Drop page-number lines, then lines of which more than half is neither letter, digit nor space."""
    x = F.regexp_replace(text, r"(?im)^\s*Page\s+\d+\s*$", "")

    def keep(line: Column) -> Column:
        bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        odd = F.length(F.regexp_replace(bare, r"[\p{L}\p{N}\s]", ""))
        return (F.length(bare) == 0) | (odd / F.length(bare) <= 0.5)

    return F.array_join(F.filter(F.split(x, "\n", -1), keep), "\n")


def linearize_tables(text: Column, gap_width: int = 3) -> Column:
    """Cells of lines with wide gaps onto lines of their own; short lines and lines without a gap stay."""
    gap = " {%d,}" % gap_width

    def split(line: Column) -> Column:
        bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        cells = F.filter(F.transform(F.split(line, gap, -1), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), lambda c: c != "")
        return F.when((F.length(bare) >= 12) & line.contains(" " * gap_width), F.array_join(cells, "\n")).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n", -1), split), "\n")


#: Polish prepositions in the order in which they are tried, and words that only look fused.
PREPOSITIONS = ("przez", "dla", "za", "na", "do", "w", "z", "o")
WHOLE_WORDS = ("zawsze", "zamek", "zakochac", "napisac", "nazwisko", "dokument", "dolina", "dostawca", "wodospad", "wszystko", "wnioski", "oczywiscie")


def polish_spacing(text: Column) -> Column:
    """Part prepositions from the word they are fused to, if three letters or more remain and it is no known word.

    One native pattern: a word that is not, diacritics folded, one of the whole words, and begins with a
    preposition. Apply it to Polish nodes only.
    """
    fold = {"a": "aą", "c": "cć", "e": "eę", "l": "lł", "n": "nń", "o": "oó", "s": "sś", "z": "zźż"}

    def loose(word: str) -> str:
        return "".join(f"[{fold[c]}]" if c in fold else c for c in word)

    known = "|".join(loose(w) for w in WHOLE_WORDS)
    first = "|".join(loose(w) for w in PREPOSITIONS)
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}])(?!(?:{known})(?!\p{{L}}))({first})(\p{{L}}{{3,}})", "$1 $2")


@F.pandas_udf(T.StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    """Repair text: the ftfy library's where it is installed, else NFC and UTF-8 read as Windows-1252 undone."""
    try:
        from ftfy import fix_text
    except ModuleNotFoundError:
        fix_text = _repaired
    return text.map(fix_text, na_action="ignore")


def _repaired(text: str) -> str:
    if "Ã" in text or "â€" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    return unicodedata.normalize("NFC", text)


CLEANERS = {"whitespace": whitespace, "hyphenation": hyphenation, "artifact-remove": artifacts, "table-linearize": linearize_tables, "unicode-normalize": normalize_unicode, "polish-dictionary-spacing": polish_spacing}


def clean(nodes: DataFrame, name: str, when: Column | None = None) -> DataFrame:
    """Nodes with a derived node in place of each that `when` holds for; others pass as they are."""
    new = CLEANERS[name](F.col("content"))
    if when is None and name == "polish-dictionary-spacing":
        when = F.col("language") == "pl"
    applies = F.coalesce(when, F.lit(False)) if when is not None else F.lit(True)
    derived = node_id(F.col("media_type"), F.col("_new"), F.array("id"), F.lit(0))
    out = nodes.withColumn("_new", F.when(applies, new))
    own = [c for c in nodes.columns if c not in ("id", "parents", "content")]
    return out.select(
        F.when(applies, derived).otherwise(F.col("id")).alias("id"),
        F.when(applies, F.array("id")).otherwise(F.col("parents")).alias("parents"),
        F.when(applies, F.col("_new")).otherwise(F.col("content")).alias("content"),
        *own,
    )

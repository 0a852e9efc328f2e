"""Nodes: extraction, chunking, table rows, keywords, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.identity import node_id, root_id


def roots(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One root node a document: (id, parents, sources, content, media_type, language)."""
    language = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.select(
        root_id(F.col(text_col)).alias("id"),
        F.array().cast("array<string>").alias("parents"),
        F.array(F.col(id_col).cast("string")).alias("sources"),
        F.col(text_col).alias("content"),
        F.lit("text").alias("media_type"),
        language.alias("language"),
    )


def fixed_size(nodes: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of `size` code points, `overlap` of them shared, each a child with its ordinal and start.

    A short last window is given even where the one before it holds all of it; an empty text has no windows.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    starts = F.when(F.length("content") > 0, F.sequence(F.lit(0), F.length("content") - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring("content", s + 1, size).alias("content")))
    out = nodes.select("id", "sources", "media_type", F.posexplode(cut).alias("ordinal", "w"))
    return out.select(
        node_id(F.col("media_type"), F.col("w.content"), F.array("id"), F.col("ordinal")).alias("id"),
        F.array("id").alias("parents"),
        "sources",
        F.col("w.content").alias("content"),
        "media_type",
        "ordinal",
        F.col("w.start").alias("start"),
    )


def _cell(x: Column) -> Column:
    """A cell's text with backslashes, bars and line ends escaped."""
    for plain, kept in (("\\", "\\\\"), ("|", "\\|"), ("\n", "\\n"), ("\r", "\\r")):
        x = F.replace(x, F.lit(plain), F.lit(kept))
    return x


def table_rows(tables: DataFrame) -> DataFrame:
    """Children of tables (id, headers, rows): `header: cell` joined by ` | `, one child a row, by its index."""
    rows = tables.select("id", "headers", F.posexplode("rows").alias("ordinal", "cells"))
    line = F.array_join(F.zip_with("headers", "cells", lambda h, c: F.concat(_cell(h), F.lit(": "), _cell(c))), " | ")
    rows = rows.withColumn("content", line)
    return rows.select(node_id(F.lit("text"), F.col("content"), F.array("id"), F.col("ordinal")).alias("id"), F.col("id").alias("parent"), "ordinal", "content")


#: Words that are no keywords.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "between", "both", "but", "by", "can", "did", "do", "does", "each", "few", "for",
    "from", "had", "has", "have", "he", "her", "his", "if", "in", "into", "is", "it", "its", "just", "more", "most", "my", "no", "not", "of", "on",
    "only", "or", "other", "our", "over", "own", "same", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "these",
    "they", "this", "those", "to", "too", "under", "very", "was", "we", "were", "will", "with", "you", "your",
)


def keywords(content: Column, top_n: int = 5) -> Column:
    """The most frequent words of three letters or more, stopwords aside; ties by first position.

    Row-local and linear: one pattern takes the words, which are then sorted, and runs of equal ones counted.
    """
    known = "|".join(STOPWORDS)
    words = F.regexp_extract_all(F.lower(content), F.lit(rf"(?<![a-z])(?!(?:{known})(?![a-z'-]))[a-z][a-z'-]{{2,}}"), F.lit(0))
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def ranked(p: Column) -> Column:
        first = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (F.try_element_at(p, F.greatest(i, F.lit(1)))["w"] != x["w"]), i)), lambda i: i.isNotNull())
        counted = F.transform(F.array(first), lambda f: F.transform(f, lambda i, j: F.struct((i - F.coalesce(F.try_element_at(f, j + 2), F.size(p))).alias("n"), p[i]["i"].alias("i"), p[i]["w"].alias("w"))))
        return F.slice(F.sort_array(counted[0]), 1, top_n)

    return F.transform(F.transform(F.array(placed), ranked)[0], lambda x: x["w"])


def render(nodes: DataFrame, by: str = "source", separator: str = "\n\n") -> DataFrame:
    """One plain text for each value of `by`, its nodes in the order of their ordinals."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "content")))
    return nodes.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["content"]), separator).alias("text"))


def markdown_table(headers: Column, rows: Column) -> Column:
    """A table as Markdown."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")

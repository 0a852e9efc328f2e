"""Files as source documents: inventory, loading with a check, text extraction."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.identity import root_id


def inventory(spark: SparkSession, root: str, suffixes: Sequence[str] = (".txt", ".md")) -> DataFrame:
    """(source_id, path, size, content_hash) of all files below a folder with one of the suffixes, by SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("path").endswith(s)
    return files.where(wanted).select(F.sha2(F.col("path").cast("binary"), 256).alias("source_id"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


def load(spark: SparkSession, root: str, refs: DataFrame) -> DataFrame:
    """(source_id, path, content) of inventoried files; one whose bytes have changed since is refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    same = F.sha2("content", 256) == F.col("content_hash")
    content = F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("changed since inventory: "), "path")).cast("binary"))
    return refs.join(files, "path").select("source_id", "path", content.alias("content"))


def text_nodes(docs: DataFrame) -> DataFrame:
    """Root nodes (id, sources, content) of strictly UTF-8 files; other bytes are refused."""
    text = F.decode("content", "UTF-8")
    strict = F.when(F.encode(text, "UTF-8") == F.col("content"), text).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path")))
    out = docs.select(F.array("source_id").alias("sources"), strict.alias("content"))
    return out.select(root_id(F.col("content")).alias("id"), "sources", "content")


def claimant(path: str, extractors: Mapping[str, Sequence[str]]) -> str:
    """The one extractor that claims a path's suffix; none or several are refused."""
    claims = [name for name, suffixes in extractors.items() if any(path.lower().endswith(s) for s in suffixes)]
    if len(claims) != 1:
        raise ValueError(f"{path} is claimed by {', '.join(claims) or 'no extractor'}")
    return claims[0]


def settings(text: str, suffix: str) -> dict:
    """The table that a configuration or question file holds, by its suffix (.toml or .json); anything else is refused."""
    out = tomllib.loads(text) if suffix == ".toml" else json.loads(text) if suffix == ".json" else None
    if not isinstance(out, dict):
        raise ValueError(f"no table in a {suffix} file")
    return out


def page_text(html: Column) -> Column:
    """The visible text of a web page: scripts, styles, comments and tags off, common entities decoded, blanks collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(x, r"\s+", " "))

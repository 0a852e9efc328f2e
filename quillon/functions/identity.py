"""Content addresses of nodes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(x: Column) -> Column:
    """A string's bytes after their number, as eight bytes, the highest first."""
    data = x.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")), data)


def node_id(media_type: Column, content: Column, parents: Column, ordinal: Column) -> Column:
    """SHA-256 over media type, content, the sorted parents and the ordinal, each after its length."""
    lineage = F.aggregate(F.array_sort(parents), F.lit(b""), lambda a, x: F.concat(a, _part(x)))
    return F.sha2(F.concat(_part(media_type), _part(content), lineage, _part(ordinal.cast("string"))), 256)


def root_id(content: Column, ordinal: Column | int = 0) -> Column:
    """The id of a text without parents."""
    at = F.lit(ordinal) if isinstance(ordinal, int) else ordinal
    return node_id(F.lit("text"), content, F.array().cast("array<string>"), at)


def hash_embedding(content: Column, dimension: int = 64) -> Column:
    """Component i: the first eight bytes of SHA-256(content, i as four bytes) as a fraction of 2**64, from -1 to 1."""
    scale = 1 / 2.0**64

    def component(i: Column) -> Column:
        head = F.substring(F.sha2(F.concat(content.cast("binary"), F.unhex(F.lpad(F.hex(i), 8, "0"))), 256), 1, 16)
        return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") * F.lit(scale) * 2 - 1

    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), component)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


#: Words of a text for ranking and overlap: letters, digits and low lines.
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(content: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(content), F.lit(TOKEN), F.lit(0))

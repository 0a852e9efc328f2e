"""Scans over arrays within a row, in linear time and memory: no array is copied for each of its elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a part; within a part, and over the parts, results are appended one by one.
PART = 256
#: Code points of a cell of a cut text.
CELL = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parts(values: Column, size: int = PART) -> Column:
    """An array cut into arrays of at most so many elements."""
    count = F.ceil(F.size(values) / size).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), 1, F.greatest(count, F.lit(0))), lambda i: F.slice(values, i * size + 1, size))


def before(values: Column, zero: Column, join: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each element what join makes of zero and all elements before it; join is associative, kind its type in SQL."""
    none = F.array().cast(f"array<{kind}>")

    def scan(array: Column, start: Column) -> Column:
        step = lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(array, F.struct(start.cast(kind).alias("at"), none.alias("out")), step, lambda a: a["out"])

    def whole(cut: Column) -> Column:
        totals = F.transform(cut, lambda p: F.aggregate(p, zero.cast(kind), lambda a, x: join(a, x)))
        return F.flatten(F.zip_with(cut, scan(totals, zero), scan))

    return let(parts(values), whole)


def running_sum(values: Column) -> Column:
    """For each element of an array<int> the sum of those before it."""
    return before(values, F.lit(0), lambda a, x: (a + x).cast("int"), "int")


def matches(text: Column, pattern: Column | str) -> Column:
    """array<struct<start:int,end:int,value:string>> of a pattern's leftmost non-overlapping matches; offsets in code points, end exclusive.

    The pieces between matches and the matches themselves give the offsets by running sums of their lengths.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("value")))
    pairs = F.filter(pairs, lambda x: x["value"].isNotNull())

    def placed(p: Column) -> Column:
        starts = running_sum(F.transform(p, lambda x: x["gap"] + x["n"]))
        return F.zip_with(p, starts, lambda x, s: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + x["n"]).alias("end"), x["value"].alias("value")))

    return let(pairs, placed)


def cells(text: Column) -> Column:
    """A text cut into cells of CELL code points, from which parts are taken without counting from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))


def taken(cut: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive, both from 0) of a text cut by `cells`."""
    first = F.floor(start / CELL).cast("int")
    last = F.floor(F.greatest(end - 1, start) / CELL).cast("int")
    held = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(held, start - first * CELL + 1, end - start)).otherwise(F.lit(""))

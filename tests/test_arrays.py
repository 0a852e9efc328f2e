"""Scans over arrays against Python's."""

import random
import re
import time

from pyspark.sql import functions as F

from quillon.functions import arrays
from quillon.operators import route


def test_running_sums_and_maxima(spark):
    r = random.Random(1)
    rows = [(k, [r.randint(0, 99) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 255, 256, 257, 1000])]
    df = spark.createDataFrame(rows, "k int, x array<int>")
    got = df.select("k", arrays.running_sum(F.col("x")).alias("s"), arrays.before(F.col("x"), F.lit(-1), F.greatest, "int").alias("m")).collect()
    for g, (_, x) in zip(sorted(got), rows):
        assert g["s"] == [sum(x[:i]) for i in range(len(x))]
        assert g["m"] == [max([-1, *x[:i]]) for i in range(len(x))]


def test_matches_and_cells(spark):
    texts = ["", "none", "a1 🙂22 é333 4", "9" * 3, "x" * 700 + "5" + "é🙂" * 600 + "77", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    cut = df.withColumn("m", arrays.matches(F.col("text"), r"\d+")).withColumn("c", arrays.cells(F.col("text")))
    for r in cut.withColumn("again", F.transform("m", lambda x: arrays.taken(F.col("c"), x["start"], x["end"]))).collect():
        if texts[r["k"]] is None:
            assert r["m"] is None
            continue
        assert [(x["start"], x["end"], x["value"]) for x in r["m"]] == [(x.start(), x.end(), x[0]) for x in re.finditer(r"\d+", texts[r["k"]])]
        assert r["again"] == [x["value"] for x in r["m"]] and "".join(r["c"]) == texts[r["k"]]


def test_anchors_of_a_text_with_very_many(spark):
    text = " ".join(f"id_{i % 50_000}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "k int, text string")
    began = time.perf_counter()
    (found,) = df.select(route.anchors(F.col("text")).alias("a")).collect()
    assert time.perf_counter() - began < 30
    assert [a["text"] for a in found["a"][:3]] == ["id_0", "id_1", "id_2"] and len(found["a"]) == 50_000


def test_only_words_that_may_be_identifiers_are_placed(spark):
    text = "plain Words-here, fooBar x1 (a_b) §12 1.2.3 ąBc " + "z" * 3000 + " end9"
    found = spark.createDataFrame([(text,)], "text string").select(F.regexp_extract_all("text", F.lit(route.MARKED), F.lit(0))).first()[0]
    assert found == ["fooBar", "x1", "(a_b)", "§12", "1.2.3", "end9"]

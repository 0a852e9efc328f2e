"""MinHash near-duplicates by an inverted join of signature coordinates.

A document is posted under each of its signature's (coordinate, value) pairs, and two documents collide as often as
they share such a pair. Only pairs that collide at least `matches` times are of interest: each document's postings are
ordered from the rarest, and two that collide so often meet within the first coordinates - matches + 1 of these, the
prefix. What is beyond a prefix is skipped; there a candidate's collisions are counted on the two signatures alone.
Pairs above the threshold are confirmed on whole sets. Of what meets, a set whose own shingles are too many for any
partner is left out before pairs are formed, and the same counts bound the sizes of the partners of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import op7_jaccard as sets_of
from quillon.llm.components import components
from quillon.llm.words import mixed
from quillon.session import table, written

#: Coordinates of a signature, and collisions that a candidate must have. Two sets of similarity 0.85 collide less often
#: with probability 9e-12.
COORDINATES, MATCHES = 64, 32
#: From so many members a list is joined by way of its leader.
LONG = 16
#: Tasks that the members of a list, and the rows that name one document, are dealt over; pairs that a copy of a set serves.
DEAL, SERVED = 16, 1000
_RANDOM = np.random.Generator(np.random.PCG64(11))
_XOR = _RANDOM.integers(0, 1 << 63, 512, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """By set and coordinate, a 64-bit name of the pair (coordinate, least hash); no set is empty."""
    out = np.empty((len(sets), coordinates), np.uint64)
    if sets:
        every = np.concatenate(sets)
        begin = np.cumsum([0, *map(len, sets[:-1])])
        for k in range(coordinates):
            out[:, k] = mixed(np.minimum.reduceat((every ^ _XOR[k]) * _ODD[k], begin) ^ mixed(np.array([k], np.uint64)))
    return out


def _signed(texts: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """(doc_id, cls, n, signature): equal sets are one class; a batch signs each of its classes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sets_of.shingle_sets(batch.column("text"), shingle))
            classes = [sets_of.class_of(s) for s in found]
            first = {c: i for i, c in reversed(list(enumerate(classes))) if c}
            rows = sorted(first.values())
            values = pa.array(signatures([found[i] for i in rows], coordinates).view(np.int64).ravel())
            sizes = np.zeros(len(found) + 1, np.int32)
            sizes[np.array(rows, np.int64) + 1] = coordinates
            signed = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), values, mask=pa.array(sizes[1:] == 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(classes, pa.int64()), pa.array([len(s) for s in found], pa.int32()), signed], names=["doc_id", "cls", "n", "signature"])

    return texts.mapInArrow(run, "doc_id long, cls long, n int, signature array<long>")


def postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(token, cls, n, own, pos): the prefix of each class that can collide often enough with any other.

    A pair that only one class holds collides with nothing: `own` of a class's are so. pos is the place in the order of
    all its pairs, its own first, then the rarest.
    """
    posts = classes.select("cls", F.explode("signature").alias("token"))
    often = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = posts.join(often, "token").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("met")).where(F.size("met") >= matches)
    held = met.withColumn("own", F.lit(coordinates) - F.size("met"))
    prefix = F.expr(f"slice(met, 1, {coordinates - matches + 1} - own)")
    each = held.join(classes.select("cls", "n"), "cls").select("cls", "n", "own", F.posexplode(prefix).alias("at", "met"))
    return each.select("met.token", "cls", "n", "own", (F.col("own") + F.col("at")).alias("pos"))


def _dealt(members: DataFrame, of_token: DataFrame) -> DataFrame:
    """members joined with what there is one row of for each token, over DEAL tasks a token."""
    salted = members.withColumn("deal", F.pmod(F.xxhash64("cls"), F.lit(DEAL)).cast("int"))
    return salted.join(of_token.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))), ["token", "deal"]).drop("deal")


def _need(x: str, y: str, percent: int) -> str:
    """The members that two sets of sizes x and y must share."""
    return f"ceil({percent} * ({x} + {y}) / {100 + percent}.0)"


def _fits(x: str, y: str, percent: int, coordinates: int, matches: int) -> str:
    """Whether two members of a list can be alike: by the shingles that others have too, and by the collisions that can stand before and after this one."""
    return f"""least({x}.n - {x}.alone, {y}.n - {y}.alone) >= {_need(f"{x}.n", f"{y}.n", percent)}
        AND least({x}.pos - {x}.own, {y}.pos - {y}.own) + {coordinates} - greatest({x}.pos, {y}.pos) >= {matches}"""


def shared_enough(sets: DataFrame, percent: int) -> DataFrame:
    """(cls, n, alone) of the classes (cls, tokens) that can be alike with another: alone is how many shingles no other has.

    Shingles are counted exactly among the classes given. A set that must share `percent` of what it has with a partner
    has none if fewer of its shingles stand elsewhere.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(t.as_buffer(), np.int64) for t in batch.column("tokens")]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cls").to_numpy(), [len(t) for t in found])), pa.array(np.concatenate(found))], names=["cls", "token"])

    size = (F.octet_length("tokens") / 8).cast("long").alias("n")
    once = sets.select("cls", "tokens").mapInArrow(single, "cls long, token long").groupBy("token").agg(F.count("*").alias("c"), F.min("cls").alias("cls")).where("c = 1")
    alone = once.groupBy("cls").agg(F.count("*").alias("alone"))
    told = sets.select("cls", size).join(alone, "cls", "left").select("cls", "n", F.coalesce("alone", F.lit(0)).alias("alone"))
    return told.where(f"100 * (n - alone) >= {percent} * n")


def _sized(n: str) -> str:
    """Sizes within 3 % of each other are one bucket."""
    return f"cast(floor(ln({n}) / ln(1.03D)) as int)"


def compared(pairs: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """(a, b, same, alike) of pairs (a, b): the members both sets have, and whether they collide so often and are similar by their whole sets.

    sets: (cls, signature, tokens). A document that stands in many pairs is copied once for each SERVED of them, so that
    no task gets all of its pairs.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / SERVED).cast("int").alias("copies")).where("copies > 1")
    salted = pairs.join(many, "b", "left").withColumn("copy", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    with_a = salted.join(sets.select(F.col("cls").alias("a"), F.col("signature").alias("sign_a"), F.col("tokens").alias("of_a")), "a")
    copied = sets.join(many, sets["cls"] == many["b"], "left").select(F.col("cls").alias("b"), F.col("signature").alias("sign_b"), F.col("tokens").alias("of_b"), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, alike = [], []
            for s, t, x, y in zip(*(batch.column(c) for c in ("sign_a", "sign_b", "of_a", "of_b"))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                same.append(int((q[at] == p).sum()))
                met = int((np.frombuffer(s.as_buffer(), np.int64) == np.frombuffer(t.as_buffer(), np.int64)).sum())
                alike.append(met >= matches and 100 * same[-1] >= percent * (len(p) + len(q) - same[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.int64()), pa.array(alike, pa.bool_())], names=["a", "b", "same", "alike"])

    return with_a.join(copied, ["b", "copy"]).select("a", "b", "sign_a", "sign_b", "of_a", "of_b").mapInArrow(run, "a long, b long, same long, alike boolean")


def _candidates(texts: DataFrame, wanted, shingle: int, coordinates: int) -> DataFrame:
    """(cls, signature, tokens), binary, of the classes in the filter."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(t.as_buffer(), np.uint64) for t in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([s.tobytes() for s in signatures(found, coordinates)], pa.binary()), batch.column("tokens")], names=["cls", "signature", "tokens"])

    return sets_of._sets(texts, wanted, shingle).mapInArrow(sign, "cls long, signature binary, tokens binary")


def links(lists: DataFrame, sets: DataFrame, percent: int, coordinates: int, matches: int) -> DataFrame:
    """Confirmed links (a, b) that connect what all links connect.

    The members of a long list are first held against its leader, the one with the fewest shingles of its own. Members
    that these links connect, in this list or another, need no pair between them; only those outside the list's largest
    group are paired with the rest. So no group of near copies costs its square, and no link between groups is lost.
    """
    size = lists.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct("alone", "own", "pos", "cls", "n")).alias("lead")).where("members > 1")
    met = written(_dealt(lists, size), "lists")
    long = met.where(F.col("members") >= LONG)
    to_leader = long.where(f"cls <> lead.cls AND {_fits('long', 'lead', percent, coordinates, matches).replace('long.', '')}")
    tried = written(compared(to_leader.select(F.col("cls").alias("a"), F.col("lead.cls").alias("b")).distinct(), sets, percent, matches), "leaders")
    stars = tried.where("alike").select("a", "b")
    group = components(stars).select(F.col("node").alias("cls"), F.col("label").alias("grp"))
    grouped = met.withColumn("leader", F.col("lead.cls")).drop("lead").join(group, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    grouped = grouped.join(tried.select(F.col("a").alias("cls"), F.col("b").alias("leader"), "same"), ["cls", "leader"], "left").withColumn("same", F.when(F.expr("cls = leader"), F.col("n")).otherwise(F.col("same")))
    # Of what two members of a list share, a part stands in their leader too; the rest can be no more than others have of either's.
    grouped = grouped.withColumn("led", F.coalesce("same", "n")).withColumn("besides", F.greatest(F.coalesce(F.expr("n - same"), "n") - F.col("alone"), F.lit(0)))
    grouped = written(grouped.drop("same", "leader"), "grouped")
    fits = F.expr(_fits("x", "y", percent, coordinates, matches))
    led = F.expr(f"least(x.led, y.led) + least(x.besides, y.besides) >= {_need('x.n', 'y.n', percent)}")
    short = grouped.where(F.col("members") < LONG)
    near = short.alias("x").join(short.alias("y"), F.expr("x.token = y.token AND x.cls < y.cls AND x.grp <> y.grp") & fits)
    rest = grouped.where(F.col("members") >= LONG)
    # A pair is made where its first common token stands: what a class has before a token tells.
    prefix = rest.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("all"))
    rest = rest.join(prefix, "cls").withColumn("before", F.expr("transform(filter(all, t -> t.pos < pos), t -> t.token)")).drop("all")
    most = rest.groupBy("token", "grp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "grp")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    inside = _dealt(rest, most.select("token", F.col("most.grp").alias("most"))).withColumn("size", F.expr(_sized("n")))
    # What a set shares bounds the sizes of its partners: it looks into the buckets of these sizes only.
    least, largest = f"greatest(1, ceil({percent} * n / 100.0))", f"least(floor(100 * n / {percent}.0), floor({100 + percent} * (n - alone) / {percent}.0) - n)"
    outside = inside.where(f"grp <> most AND {largest} >= {least}").withColumn("size", F.explode(F.expr(f"sequence({_sized(least)}, {_sized(largest)})")))
    apart = outside.alias("x").join(inside.alias("y"), F.expr("x.token = y.token AND x.size = y.size AND x.grp <> y.grp AND (y.grp = y.most OR x.cls < y.cls)") & fits & led & ~F.arrays_overlap("x.before", "y.before"))
    pairs = near.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).union(apart.select(F.least("x.cls", "y.cls"), F.greatest("x.cls", "y.cls"))).distinct()
    return compared(written(pairs, "pairs"), sets, percent, matches).where("alike").select("a", "b").union(stars)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document: components of links of `percent` or more.

    Words are runs of anything but ASCII blanks, A-Z folded; a set is the distinct runs of `shingle` words, or the
    whole sequence of a shorter text. `matches` defaults to 7.7 standard deviations below what sets of that similarity
    collide on average. Null texts and those without words are linked with nothing. Equal sets are one class. Repeated
    rows are one class; a null id is kept and, where others are in its component, not its name. One document of each
    component is kept, the one that names it (all rows of that id; rows without an id where no row has one). Other
    columns play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if matches is None:
        share = percent / 100
        matches = max(1, int(coordinates * share - 7.7 * (coordinates * share * (1 - share)) ** 0.5))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(_signed(texts, shingle, coordinates), "signed")
    classes = signed.where("signature IS NOT NULL").select("cls", "n", "signature").dropDuplicates(["cls"])
    classes = written(classes, "classes")
    lists = written(postings(classes, coordinates, matches), "postings")
    wanted = sets_of._bitmap(lists.select("cls").distinct())
    sets = written(_candidates(texts.select("text"), spark.sparkContext.broadcast(wanted), shingle, coordinates), "candidates")
    lists = lists.drop("n").join(written(shared_enough(sets, percent), "shared"), "cls")
    labels = components(links(lists, sets, percent, coordinates, matches))
    lowest = signed.groupBy("cls").agg(F.min("doc_id").alias("low")).join(labels, F.col("cls") == F.col("node"), "left").select("cls", "low", F.coalesce("label", "cls").alias("label"))
    names = lowest.where("cls <> 0").groupBy("label").agg(F.min("low").alias("component"))
    named = lowest.join(names, "label", "left").select("cls", "component")
    out = signed.select("doc_id", "cls", F.col("n").cast("long").alias("n_shingles")).join(named, "cls")
    out = out.withColumn("component_id", F.when(F.col("cls") == 0, F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles counted, its component of near copies named, and one of each component kept."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, matches=MATCHES)


OP11_SQL = sets_of.OP7_SQL.replace("100 * count(*) >= 90 * (a.n + b.n - count(*))", "100 * count(*) >= 85 * (a.n + b.n - count(*))").replace("SELECT doc_id, n_shingles, component_id\n", "SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept\n")

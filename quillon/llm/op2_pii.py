"""Information-theoretic sanitisation of personal data. DataFrame functions only.

Entities to protect are found by four base formats, and each is protected on three levels: its value (however it is
written), its class (mail domain, network, issuer, area) and its kind. A term reveals an entity as far as it raises
the entity's probability: PMI(term; entity) = log2(p(entity | term) / p(entity)), at most the entity's information
content IC = -log2 p(entity). Terms with PMI >= disclosure * IC are found in the documents that hold the entity, and
are generalised to a shared word beginning, where that reveals less, or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import arrays
from quillon.session import table, written

#: The base formats in their order. Quantifiers are possessive where what follows cannot match what
#: they took, and a run is entered at its start only (or where the last match ended): the matches are those of the
#: plain patterns, without their backtracking.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must match for a format to be looked for.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{12}", "phone": r"\+[0-9]"}
#: A number up to 255 after any zeros; the zeros are given back where they are the whole part.
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters beside an entity that are its context, and the distinct texts a pair must share.
CONTEXT, SUPPORT = 120, 2
#: Values whose document counts are broadcast: those of most documents, so many at most.
HOT = 256
#: Share of an entity's information that a term may reveal.
DISCLOSURE = 0.9
WORD = r"\p{L}{3,}+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn sum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str):
    """The condition on a span for a match of the kind's pattern to count."""
    return lambda span: _holds(kind, span["value"])


def _holds(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^(?:{_OCTET}(?:\.|$)){{4}}$")
    if kind == "card":
        return F.length(_digits(x)).between(13, 19) & _luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _joined(kind: str, spans: Column) -> Column:
    """kind:start:end of every span."""
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def levels(kind: str, value: Column) -> Column:
    """What is protected of an entity, as array<string>: its value, its class and its kind.

    The value is an address in lower case or without leading zeros, or the digits of a number; the class is the mail
    domain, the first two parts of an address, the first six digits of a card or the first four of a phone number.
    """
    if kind == "email":
        own, group = F.lower(value), F.regexp_extract(F.lower(value), "@.*", 0)
    elif kind == "ip":
        own = F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1")
        group = F.regexp_extract(own, r"^[0-9]+\.[0-9]+", 0)
    else:
        own = _digits(value)
        group = F.substring(own, 1, 6 if kind == "card" else 4)
    return F.array(F.concat(F.lit(f"{kind}="), own), F.concat(F.lit(f"{kind}:"), group), F.lit(kind))


def base(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, own, email, ip, card, phone): the base spans of every whole text; a null text counts as empty.

    `own` holds all columns of docs as one struct.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), own.alias("own"))
    for kind in KINDS:
        may = F.col("text").contains("@") if kind == "email" else F.col("text").rlike(GUARDS[kind])
        spans = F.filter(arrays.matches(F.col("text"), PATTERNS[kind]), _valid(kind))
        out = out.withColumn(kind, F.when(may, spans).otherwise(none))
    return out


def _near(cut: Column, size: Column, span: Column) -> Column:
    """The distinct lower-case words within CONTEXT characters of a span of a text (its cells and length); words cut at the border are left out."""
    before = arrays.taken(cut, F.greatest(span["start"] - CONTEXT, F.lit(0)), span["start"])
    before = F.when(span["start"] > CONTEXT, F.regexp_replace(before, r"^\S*+", "")).otherwise(before)
    after = arrays.taken(cut, span["end"], F.least(span["end"] + CONTEXT, size))
    after = F.when(size > span["end"] + CONTEXT, F.regexp_replace(after, r"(?<!\S)\S*$", "")).otherwise(after)
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(before, F.lit(" "), after)), F.lit(WORD), F.lit(0)))


def _words(text: Column) -> Column:
    """The distinct lower-case words of a whole text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _protected(kind: str) -> Column:
    """A kind's spans as array<struct<start,end,levels>>."""
    return F.transform(kind, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), levels(kind, e["value"]).alias("levels")))


def disclosing(texts: DataFrame, found: DataFrame, *, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(value, term, general) of the terms that reveal an entity on one of its levels, from counts over all documents.

    `texts` has every document's text, `found` has rows (rid, text, entities), an entity being (start, end, levels).
    p(entity | term) is the share of the term's documents in which it stands near the entity; a pair counts from
    `support` distinct texts, so copies alone prove nothing. An entity that is in every document has nothing to
    reveal. `general` is the term's beginning where the mentions of all terms that begin so, counted like those of
    the term, reveal less than the threshold; else it is empty.
    """
    n = texts.count()
    near = found.select("rid", F.xxhash64("text").alias("text_hash"), "entities", arrays.cells(F.col("text")).alias("cut"), F.length("text").alias("size"))
    near = near.select("rid", "text_hash", F.explode(F.transform("entities", lambda e: F.struct(e["levels"].alias("levels"), _near(F.col("cut"), F.col("size"), e).alias("words")))).alias("e"))
    near = near.select("rid", "text_hash", F.explode("e.levels").alias("value"), "e.words")
    near = near.select("rid", "text_hash", "value", F.explode("words").alias("term")).distinct()
    by_text = near.groupBy("value", "term", "text_hash").agg(F.count("*").alias("docs"))
    pairs = written(by_text.groupBy("value", "term").agg(F.count("*").alias("texts"), F.sum("docs").alias("together")), "pairs")
    counts = written(texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term")), "terms")
    of = found.select("rid", F.explode(F.array_distinct(F.flatten("entities.levels"))).alias("value")).groupBy("value").agg(F.count("*").alias("with_value"))
    # The values of most documents (the kinds among them) have the most pairs: their counts go to the pairs, not to a task.
    hot = of.orderBy(F.desc("with_value"), "value").limit(HOT)
    known = pairs.where(F.col("texts") >= support).join(counts, "term").join(F.broadcast(hot), "value", "left")
    joined = known.where("with_value is not null").unionByName(known.where("with_value is null").drop("with_value").join(of, "value"))
    content = -F.log2(F.col("with_value") / n)
    reveals = F.log2(F.col("together") / F.col("with_term")) + content
    over = joined.withColumn("content", content).where((F.col("content") > 0) & (reveals >= disclosure * F.col("content"))).withColumn("begin", F.substring("term", 1, 3))
    over = written(over.select("value", "term", "begin", "content"), "revealing")
    asked = over.select("value", "begin").distinct()
    begins = counts.groupBy(F.substring("term", 1, 3).alias("begin")).agg(F.sum("with_term").alias("with_begin"))
    beside = pairs.join(counts.select("term"), "term").groupBy("value", F.substring("term", 1, 3).alias("begin")).agg(F.sum("together").alias("begin_together"))
    told = asked.join(beside, ["value", "begin"]).join(begins, "begin")
    less = F.log2(F.col("begin_together") / F.col("with_begin")) + F.col("content") < disclosure * F.col("content")
    return over.join(told, ["value", "begin"]).select("value", "term", F.when(less, F.concat("begin", F.lit("*"))).otherwise("").alias("general"))


def _apart(spans: Column, others: Column) -> Column:
    """The spans (disjoint, by start) that touch none of the others, whatever their number: by the largest end of those
    that begin before a span, and by the first of those that begin in it."""
    mixed = F.array_sort(F.concat(
        F.transform(others, lambda e: F.struct(e["start"].alias("start"), F.lit(0).alias("own"), e["end"].alias("end"), F.lit(None).cast("string").alias("value"))),
        F.transform(spans, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("own"), t["end"].alias("end"), t["value"].alias("value"))),
    ))

    def told(m: Column) -> Column:
        ends = arrays.before(F.transform(m, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x), "int")
        later = F.reverse(arrays.before(F.reverse(F.transform(m, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(2**31 - 1))), F.lit(2**31 - 1), lambda a, x: F.least(a, x), "int"))
        kept = F.zip_with(m, F.arrays_zip(ends.alias("e"), later.alias("l")), lambda x, y: F.when((x["own"] == 1) & (y["e"] <= x["start"]) & (y["l"] >= x["end"]), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))))
        return F.filter(kept, lambda x: x.isNotNull())

    return arrays.let(mixed, told)


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, whole: bool = False) -> DataFrame:
    """(rid, doc_id, text, own, email, ip, card, phone, term, general): base spans, and those of the terms that reveal them.

    One row a document, repeated rows and null ids included; null and empty texts have no spans. `text` and `own`
    (all columns of docs, so that their names cannot clash) are null where a document has no base span, for nothing
    there needs a change, unless they are wanted as a whole. Term spans have (start, end, value) and touch no base
    span; `general` maps a term to what stands for it ("" if it is to be removed). An empty table gives an empty result.
    """
    any_of = F.concat(*KINDS)
    based = base(docs, id_col=id_col, text_col=text_col).withColumn("rid", F.monotonically_increasing_id())
    if not whole:
        based = based.withColumn("text", F.when(F.size(any_of) > 0, F.col("text"))).withColumn("own", F.lit(None).cast("int"))
    based = written(based, "pii")
    entities = F.concat(*[_protected(k) for k in KINDS])
    held = based.where(F.size(any_of) > 0).select("rid", "text", entities.alias("entities"))
    reveal = disclosing(docs.select(F.col(text_col).alias("text")), held, support=support, disclosure=disclosure)
    reveal = written(reveal, "terms_of")
    of = held.select("rid", F.explode(F.array_distinct(F.flatten("entities.levels"))).alias("value"))
    said = held.select("rid", F.explode(_words(F.col("text"))).alias("term"))
    terms = said.join(reveal, "term").join(of, ["rid", "value"]).groupBy("rid", "term").agg(F.min("general").alias("general"))
    terms = terms.groupBy("rid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "general")))).alias("general"))
    terms = terms.withColumn("terms", F.map_keys("general"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    free = _apart(arrays.matches(F.col("text"), pattern), F.col("entities"))
    spans = held.join(terms, "rid").select("rid", free.alias("term"), "general")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return based.join(spans, "rid", "left").withColumn("term", F.coalesce("term", none))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """The rows and columns of docs: entities become [KIND], terms that reveal them are generalised or removed.

    Texts without an entity stay as they are. Where spans overlap, the one that starts first is replaced and the
    other's remainder with it.
    """
    found = detect(docs, id_col=id_col, text_col=text_col, support=support, disclosure=disclosure, whole=True)

    def marked(spans: str, mark) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), mark(x).alias("mark")))

    marks = [marked(k, lambda x, m=f"[{k.upper()}]": F.lit(m)) for k in KINDS]
    marks.append(marked("term", lambda x: F.coalesce(F.col("general")[F.lower(x["value"])], F.lit(""))))
    # A mark stands for what is between its start and its end; one that begins in another before it is part of that.
    def rewritten(m: Column) -> Column:
        ends = arrays.before(F.transform(m, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x), "int")
        pieces = F.zip_with(m, ends, lambda x, at: F.when(x["start"] >= at, F.concat(arrays.taken(F.col("cut"), at, x["start"]), x["mark"])).otherwise(""))
        last = F.array_max(F.concat(F.array(F.lit(0)), F.transform(m, lambda x: x["end"])))
        return F.concat(F.array_join(pieces, ""), arrays.taken(F.col("cut"), last, F.length("text")))

    found = found.withColumn("cut", arrays.cells(F.col("text")))
    cleaned = arrays.let(F.array_sort(F.concat(*marks)), rewritten)
    text = F.when(F.size(F.concat(*KINDS)) > 0, cleaned).otherwise(F.col("own")[text_col])
    return found.select(*[text.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and the terms that reveal them."""
    found = detect(table(spark, sf_dir, "documents"))
    plain = F.concat(*[_joined(k, F.col(k)) for k in KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    everything = F.concat(plain, _joined("term", F.col("term")))
    return found.select("doc_id", *counts, F.sha2(F.array_join(plain, ","), 256).alias("base_sha256"), F.array_join(everything, ",").alias("spans"), F.size("term").cast("long").alias("n_term"))

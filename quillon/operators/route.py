"""Queries: anchors, profiles, routing rules, hedges, boolean expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import arrays
from quillon.functions.identity import cosine

#: Routes that may be compared with a question.
MAX_ROUTES = 10_000
#: Phrases by locale and cue, and hedges by locale.
CUES = {
    "en": {
        "comparison": ("compare", "versus", "vs", "difference between"),
        "aggregation": ("how many", "total", "count", "sum of", "average"),
        "global": ("overall", "in general", "across all", "as a whole"),
        "temporal": ("since", "before", "after", "during", "timeline"),
        "cross-document": ("across documents", "between the documents", "in both documents", "across sources"),
    },
    "pl": {
        "comparison": ("porównaj", "w porównaniu", "różnica między"),
        "aggregation": ("ile", "łącznie", "suma", "średnia"),
        "global": ("ogółem", "ogólnie", "w całości", "we wszystkich"),
        "temporal": ("od kiedy", "do kiedy", "przed", "w trakcie", "chronologia"),
        "cross-document": ("w obu dokumentach", "między dokumentami", "w różnych źródłach"),
    },
}
HEDGES = {
    "en": ("i'm not sure", "i am not sure", "i don't know", "i do not know", "it is unclear", "it's unclear", "hard to say", "difficult to say", "i cannot determine", "i can't determine", "not certain", "cannot be determined"),
    "pl": ("nie jestem pewien", "nie jestem pewna", "nie wiem", "trudno powiedzieć", "trudno jednoznacznie", "niejasne", "nie jest jasne", "nie da się jednoznacznie stwierdzić", "brak pewności", "nie sposób ustalić"),
}

#: Words that may be identifiers: they hold a digit, a low line or a capital after a small letter. Looked for from a word's begin alone.
MARKED = r"(?<!\S)(?=\S*(?:\d|_|[a-z][A-Z]))\S+"
#: Quotes, characters stripped from tokens, and the shapes of identifiers and amounts.
QUOTED = r'"([^"]*)"|“([^”]*)”|`([^`]*)`'
STRIP = r".,;:!?()\[\]{}'\"§"
AMOUNT = r"(?i)^\d+(\.\d+)?\s?([kmgtp]i?b|[kmg]?hz|[kmg]?bps|[mµun]?s)$"
ORDINAL = r"(?i)^\d+(st|nd|rd|th)$"


def _identifier(token: Column) -> Column:
    both = token.rlike("[A-Za-z]") & token.rlike(r"\d") & ~token.rlike(ORDINAL)
    number = token.rlike(r"^\d{3,}$") | token.rlike(r"^\d+(\.\d+)+$")
    joined = token.rlike(r"(?U)[\p{L}\p{N}]_[\p{L}\p{N}]")
    camel = token.rlike(r"^[a-z]{2,}[A-Z][a-z]")
    return ~token.rlike(AMOUNT) & (both | number | joined | camel)


def anchors(text: Column, entities: Sequence[str] = ()) -> Column:
    """array<struct<at,text,kind>>: quoted spans, given entities, identifier-like tokens; by place, each text once.

    What one rule takes is blanked for the next: text before a match is kept in length, so places stay.
    """
    empty = F.array().cast("array<struct<at:int,text:string,kind:string>>")

    def placed(source: Column, pattern: str, kind: str, inner) -> Column:
        return F.transform(arrays.matches(source, pattern), lambda m: F.struct(m["start"].alias("at"), inner(m["value"]).alias("text"), F.lit(kind).alias("kind")))

    def blank(source: Column, pattern: str) -> Column:
        found, gaps = F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), F.split(source, pattern, -1)
        return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.repeat(F.lit(" "), F.length(F.coalesce(m, F.lit("")))))), "")

    quoted = F.filter(placed(text, QUOTED, "quoted", lambda m: F.trim(F.substring(m, 2, F.length(m) - 2))), lambda x: x["text"] != "")
    rest, named = blank(text, QUOTED), empty
    if entities:
        pattern = r"(?<![A-Za-z0-9_])(?:" + "|".join(re.escape(e) for e in sorted(entities, key=len, reverse=True)) + r")(?![A-Za-z0-9_])"
        named, rest = placed(rest, pattern, "entity", lambda m: m), blank(rest, pattern)
    # The text without what was taken is made once; of its words only those that may be identifiers are placed and looked at.
    token = arrays.let(rest, lambda r: placed(r, MARKED, "identifier", lambda m: F.regexp_replace(m, f"^[{STRIP}]+|[{STRIP}]+$", "")))
    shaped = F.filter(token, lambda x: (x["text"] != "") & _identifier(x["text"]))
    everything = F.array_sort(F.concat(quoted, named, shaped))
    # The first of each text: equal texts stand together by place, and a new text begins where the one before differs.
    by_text = F.array_sort(F.transform(everything, lambda x: F.struct(x["text"].alias("text"), x["at"].alias("at"), x["kind"].alias("kind"))))
    first = arrays.let(by_text, lambda t: F.filter(t, lambda x, i: (i == 0) | (F.get(t, i - 1)["text"] != x["text"])))
    return F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text"), x["kind"].alias("kind"))))


def cue_columns(text: Column, locale: str = "en") -> dict[str, Column]:
    """Whether each family of cues fires: a whole phrase stands in the text."""
    folded = F.lower(text)
    table = CUES.get(locale) or CUES.get(locale.split("-")[0]) or {}
    return {cue: folded.rlike(r"(?U)(?<!\w)(" + "|".join(map(re.escape, phrases)) + r")(?!\w)") for cue, phrases in table.items()}


def profile(queries: DataFrame, locale: str = "en") -> DataFrame:
    """(query_id, word_count, identifiers, quoted, one column a cue) of questions (query_id, text)."""
    found = queries.withColumn("anchors", anchors(F.col("text")))
    count = lambda kind: F.size(F.filter("anchors", lambda a: a["kind"] == kind))
    cues = [c.alias("cue_" + name.replace("-", "_")) for name, c in cue_columns(F.col("text"), locale).items()]
    words = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return found.select("query_id", words.alias("word_count"), count("identifier").alias("identifiers"), count("quoted").alias("quoted"), *cues)


def ladder(features: DataFrame, rules: Sequence[tuple[str, Sequence[tuple[str, str, float]]]], default: str) -> DataFrame:
    """The first rule all of whose (feature, operator, bound) conditions hold; an unknown value fails a condition."""
    choice = F.lit(default)
    for name, conditions in reversed(rules):
        holds = F.lit(True)
        for feature, op, bound in conditions:
            if feature not in features.columns:
                raise ValueError(f"no feature {feature}")
            x = F.col(feature).cast("double")
            holds = holds & F.coalesce({"<": x < bound, "<=": x <= bound, ">": x > bound, ">=": x >= bound, "=": x == bound}[op], F.lit(False))
        choice = F.when(holds, F.lit(name)).otherwise(choice)
    return features.withColumn("route", choice)


def nearest_description(queries: DataFrame, routes: DataFrame) -> DataFrame:
    """The route whose description's vector is nearest to the question's; ties by name.

    Routes are a catalogue, which is broadcast; more than MAX_ROUTES are refused.
    """
    if routes.limit(MAX_ROUTES + 1).count() > MAX_ROUTES:
        raise ValueError(f"more than {MAX_ROUTES} routes")
    pairs = queries.join(F.broadcast(routes.select("route", F.col("vector").alias("told"))))
    scored = pairs.select("query_id", "route", F.round(cosine(F.col("vector"), F.col("told")), 9).alias("score"))
    best = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("far"), "route")).alias("b"))
    return best.select("query_id", F.col("b.route").alias("route"), (-F.col("b.far")).alias("score"))


def evidence(features: DataFrame, rules: Sequence[tuple[str, Column, int | None]], offered: Sequence[str], tokens_known: Column, ceiling: int, fallback: str) -> DataFrame:
    """The first rule that holds, is offered and fits the ceiling on prompt tokens; `reasons` says why others fell."""
    choice, reasons = F.lit(fallback), []
    for name, holds, cost in reversed(rules):
        may = name in offered
        fits = F.lit(True) if cost is None else F.coalesce(tokens_known * cost <= ceiling, F.lit(False))
        choice = F.when(F.coalesce(holds, F.lit(False)) & F.lit(may) & fits, F.lit(name)).otherwise(choice)
        reasons.insert(0, F.when(~F.coalesce(holds, F.lit(False)), F.lit(f"{name}: does not hold")).when(F.lit(not may), F.lit(f"{name}: not offered")).when(~fits, F.lit(f"{name}: over the ceiling")))
    return features.withColumn("route", choice).withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull()))


def hedged(draft: Column, locale: str = "en") -> Column:
    """'sufficient', 'insufficient' where a hedge stands in the draft, 'unobserved' without a draft."""
    folded = F.lower(draft)
    found = F.lit(False)
    for marker in HEDGES[locale]:
        found = found | F.contains(folded, F.lit(marker))
    return F.when(draft.isNull(), "unobserved").when(found, "insufficient").otherwise("sufficient")


def parse_boolean(text: str, depth: int = 3):
    """A nested ("and" | "or", ...), ("not", x) tree of quoted or bare terms; or < and < not, parentheses."""
    parts = re.findall(r'\(|\)|"[^"]*"|[^\s()]+', text)
    at = 0

    def either(level: int):
        nonlocal at
        items = [both(level)]
        while at < len(parts) and parts[at].lower() == "or":
            at += 1
            items.append(both(level))
        return items[0] if len(items) == 1 else ("or", *items)

    def both(level: int):
        nonlocal at
        items = [single(level)]
        while at < len(parts) and parts[at].lower() == "and":
            at += 1
            items.append(single(level))
        return items[0] if len(items) == 1 else ("and", *items)

    def single(level: int):
        nonlocal at
        if at >= len(parts):
            raise ValueError("a term is missing")
        token, at = parts[at], at + 1
        if token.lower() == "not":
            return ("not", single(level))
        if token == "(":
            if level >= depth:
                raise ValueError("nested too deep")
            inside = either(level + 1)
            if at >= len(parts) or parts[at] != ")":
                raise ValueError("a parenthesis is missing")
            at += 1
            return inside
        if token == ")" or token.lower() in ("and", "or"):
            raise ValueError(f"unexpected {token}")
        return token.strip('"')

    tree = either(0)
    if at != len(parts):
        raise ValueError(f"unexpected {parts[at]}")
    return tree


def always(queries: DataFrame, route: str) -> DataFrame:
    """(query_id, route): one route for every question."""
    return queries.select("query_id", F.lit(route).alias("route"))


def offered(catalogue: Sequence[dict], ready: Sequence[str], roles: Sequence[str], tokens_known: bool) -> tuple[list[str], dict[str, str]]:
    """(names of the routes that can be taken, why each other one cannot).

    A route is {name, summary, layers, roles, counts_tokens}: it needs a summary, its layers ready, its roles mapped
    to models and, where it counts tokens, a corpus whose tokens are known.
    """
    may, why = [], {}
    for r in catalogue:
        missing = [x for x in r.get("layers", ()) if x not in ready], [x for x in r.get("roles", ()) if x not in roles]
        if not r.get("summary"):
            why[r["name"]] = "no summary"
        elif missing[0]:
            why[r["name"]] = f"not ready: {', '.join(missing[0])}"
        elif missing[1]:
            why[r["name"]] = f"no model for: {', '.join(missing[1])}"
        elif r.get("counts_tokens") and not tokens_known:
            why[r["name"]] = "tokens are not known"
        else:
            may.append(r["name"])
    return may, why

"""Evidence from recorded runs: which invocation of an experiment counts, and what its arms say against the baseline.

records (experiment, digest, invocation, arm, repetition, started, metric, question_id, value), one row a score;
grid (experiment, digest, arm, repeats, baseline), what an experiment asks for. Records of another digest are those of
another experiment, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OWN = ["experiment", "digest"]
_RUN = [*_OWN, "invocation", "arm", "repetition"]


def as_of(records: DataFrame, moment: Column | str | None = None) -> DataFrame:
    """The score of each run, metric and question that stood at a moment: of several the last that had begun by then."""
    seen = records if moment is None else records.where(F.col("started") <= (F.lit(moment) if isinstance(moment, str) else moment))
    last = F.max_by(F.struct("value", "started"), F.struct("started", "value"))
    return seen.groupBy(*_RUN, "metric", "question_id").agg(last.alias("last")).select(*_RUN, "metric", "question_id", "last.value", "last.started")


def completeness(records: DataFrame, grid: DataFrame) -> DataFrame:
    """(experiment, digest, invocation, began, missing) of every invocation: the arms and repetitions of the grid that it lacks, in order.

    An invocation is complete if nothing is missing. Arms and repetitions beyond the grid play no part.
    """
    asked = grid.select(*_OWN, "arm", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("repetition"))
    ran = records.groupBy(*_RUN).agg(F.min("started").alias("began"))
    known = ran.groupBy(*_OWN, "invocation").agg(F.min("began").alias("began"))
    cells = known.join(asked, _OWN).join(ran.select(*_RUN, F.lit(True).alias("ran")), _RUN, "left")
    lacks = F.when(F.col("ran").isNull(), F.concat_ws("#", "arm", F.col("repetition").cast("string")))
    return cells.groupBy(*_OWN, "invocation", "began").agg(F.array_sort(F.collect_list(lacks)).alias("missing"))


def chosen(invocations: DataFrame, grid: DataFrame, policy: str = "single", named: DataFrame | None = None) -> DataFrame:
    """(experiment, digest, outcome, invocation, complete): the invocation that counts for each experiment of the grid.

    With `single` the one complete invocation: 'incomplete' where there is none, 'ambiguous' where there are several,
    and then no invocation. With `latest` the complete one that began last, by name on ties. An experiment in `named`
    (experiment, invocation) has that one if it is complete, else it is 'incomplete', whatever others are.
    """
    if policy not in ("single", "latest"):
        raise ValueError("policy is single or latest")
    whole = invocations.where(F.size("missing") == 0)
    if named is not None:
        asked = named.select("experiment", F.col("invocation").alias("asked"))
        whole = whole.join(asked, "experiment", "left").where("asked IS NULL OR asked = invocation").drop("asked")
    told = whole.groupBy(*_OWN).agg(F.count("*").alias("complete"), F.max(F.struct("began", "invocation"))["invocation"].alias("last"))
    every = grid.select(*_OWN).distinct().join(told, _OWN, "left").withColumn("complete", F.coalesce("complete", F.lit(0)))
    outcome = F.when(F.col("complete") == 0, "incomplete").when((F.col("complete") > 1) & F.lit(policy == "single"), "ambiguous").otherwise("chosen")
    return every.select(*_OWN, outcome.alias("outcome"), F.when(outcome == "chosen", F.col("last")).alias("invocation"), "complete")


def evidence(records: DataFrame, choice: DataFrame, grid: DataFrame) -> DataFrame:
    """(experiment, digest, invocation, arm, metric, baseline_mean, arm_mean, n, delta, low, high, verdict) of the chosen invocations.

    delta pools arm minus baseline over the questions that both answered in the same repetition, n of them. low and
    high are the least and greatest mean of the baseline's repetitions; a delta beyond their distance is 'beyond
    spread', else 'within spread', and 'no spread' where the baseline ran once. Scores that are null count nowhere.
    """
    counted = records.where("value IS NOT NULL").join(choice.where("outcome = 'chosen'").select(*_OWN, "invocation"), [*_OWN, "invocation"])
    held = counted.join(grid.select(*_OWN, "arm", "repeats", "baseline"), [*_OWN, "arm"]).where("repetition < repeats")
    base, arms = held.where("baseline"), held.where("NOT baseline")
    key = [*_OWN, "invocation", "metric"]
    reps = base.groupBy(*key, "repetition").agg(F.avg("value").alias("mean"))
    spread = reps.groupBy(*key).agg(F.min("mean").alias("low"), F.max("mean").alias("high"), F.count("*").alias("reps"))
    of_base = base.groupBy(*key).agg(F.avg("value").alias("baseline_mean")).join(spread, key)
    both = arms.join(base.select(*key, "repetition", "question_id", F.col("value").alias("was")), [*key, "repetition", "question_id"])
    delta = both.groupBy(*key, "arm").agg(F.count("*").alias("n"), F.avg(F.col("value") - F.col("was")).alias("delta"))
    out = arms.groupBy(*key, "arm").agg(F.avg("value").alias("arm_mean")).join(of_base, key).join(delta, [*key, "arm"], "left")
    verdict = F.when(F.col("reps") < 2, "no spread").when(F.abs("delta") > F.col("high") - F.col("low"), "beyond spread").when(F.col("delta").isNotNull(), "within spread")
    rounded = [F.round(c, 9).alias(c) for c in ("baseline_mean", "arm_mean")]
    return out.select(*_OWN, "invocation", "arm", "metric", *rounded, F.coalesce("n", F.lit(0)).alias("n"), *[F.round(c, 9).alias(c) for c in ("delta", "low", "high")], verdict.alias("verdict"))

"""Plans over scores: ranking and answer metrics, aggregates, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import metrics
from quillon.operators import runs, search
from quillon.plans import sql
from quillon.session import spread, table


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth embedding asks; nodes of its label are relevant."""
    e = table(spark, sf_dir, "embeddings")
    nodes = e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"), "label")
    asked = nodes.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "vector", "label")
    labels = asked.select("query_id", "label").distinct()
    many = labels.join(nodes.groupBy("label").agg(F.countDistinct("node_id").alias("n")), "label").groupBy("query_id").agg(F.sum("n").alias("n"))
    hits = search.vector_top_k(asked.select("query_id", "vector"), nodes, 20).where("rank < 10")
    good = hits.join(labels, "query_id").join(nodes.select("node_id", "label"), ["node_id", "label"], "left_semi")
    return metrics.counted_scores(good.select("query_id", "rank"), many, 10)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the turn after it."""
    t = spread(table(spark, sf_dir, "conversations"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("answer")).join(after, ["conv_id", "turn"])


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, r = F.col("answer"), F.col("reference")
    scores = {
        "exact": metrics.exact_match(a, r), "contained": metrics.accuracy(a, r), "f1": metrics.token_f1(a, r), "recall": metrics.token_recall(a, r),
        "overlap": metrics.token_overlap(a, r), "rouge1": metrics.rouge_n(a, r, 1), "rouge2": metrics.rouge_n(a, r, 2),
    }
    return _pairs(spark, sf_dir).select("conv_id", "turn", *[F.round(x, 9).alias(n) for n, x in scores.items()])


def rouge_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.rouge_l("answer", "reference"), 9).alias("rouge_l"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def metric_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("source") == "src7", "failed").when(F.col("source") == "src8", "nothing").otherwise("produced")
    scores = _labelled(spark, sf_dir).select("lang", status.alias("status"), F.col("quality").cast("double").alias("value"))
    return metrics.aggregate(scores, "lang")


def metric_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _labelled(spark, sf_dir).select(F.lit("quality").alias("metric"), "lang", "source", F.col("quality").cast("double").alias("value"))
    return metrics.slices(scores, "metric", "lang", "source")


def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf_dir, "events").select("event_type", "value"), 0.95, "event_type")


def _arm(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return _labelled(spark, sf_dir).select(F.col("lang").alias("metric"), F.col("doc_id").alias("question_id"), F.col(column).cast("double").alias("value"))


def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired(_arm(spark, sf_dir, "quality"), _arm(spark, sf_dir, "toxic"))


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _arm(spark, sf_dir, "quality").join(_arm(spark, sf_dir, "toxic").withColumnRenamed("value", "y"), ["metric", "question_id"])
    found = metrics.intervals(both.select("metric", "question_id", (F.col("y") - F.col("value")).alias("value")))
    return found.withColumn("verdict", metrics.verdict(F.col("low"), F.col("high"), (F.col("low") + F.col("high")) / 2, 0.1))


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("metric"), (F.col("event_id") % 3).alias("rep"), F.concat(F.lit("arm"), F.col("event_id") % 2).alias("arm"), F.col("user_id").alias("question_id"), F.col("value"))


def baseline_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spread(_reps(spark, sf_dir))


def replay_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.oracle(_reps(spark, sf_dir))


def pairwise_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    say = lambda c: F.when(c == 1, "a").otherwise("b")
    return metrics.pairwise(table(spark, sf_dir, "labels").select(say(F.col("quality")).alias("forward"), say(1 - F.col("toxic")).alias("backward")))


_PAIRS = "p AS (SELECT a.conv_id, a.turn, a.text AS answer, b.text AS reference FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"


def _common(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))), 0)"


_SQ = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
_F1 = "round(CASE WHEN {c} = 0 THEN 0.0 ELSE 2.0::DOUBLE * {c} / (len({a}) + len({b})) END, 9)"
_LAB = "l AS (SELECT doc_id, lang, source, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM documents JOIN labels USING (doc_id))"
_REPS = "r AS (SELECT event_type AS metric, event_id % 3 AS rep, 'arm' || (event_id % 2) AS arm, user_id AS question_id, value FROM events)"

def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as scores of runs: users by hundreds of groups are experiments, ten days an invocation, kinds arms; as they stood on a day."""
    events = table(spark, sf_dir, "events")
    made = events.select(
        F.concat(F.lit("x"), (F.col("user_id") % 40).cast("string")).alias("experiment"), F.lit("d").alias("digest"), F.floor(F.dayofmonth("ts") / 10).cast("string").alias("invocation"),
        F.col("event_type").alias("arm"), (F.col("event_id") % 2).alias("repetition"), F.col("ts").alias("started"), F.lit("value").alias("metric"), F.col("user_id").alias("question_id"), "value",
    )
    grid = made.groupBy("experiment", "digest", "arm").agg(F.lit(2).alias("repeats")).withColumn("baseline", F.col("arm") == "click")
    return runs.as_of(made, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz").cast(events.schema["ts"].dataType)), grid


def evidence_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which invocation of each experiment counts where only one may be complete."""
    records, grid = _records(spark, sf_dir)
    return runs.chosen(runs.completeness(records, grid), grid).drop("digest")


def evidence_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every invocation lacks."""
    records, grid = _records(spark, sf_dir)
    return runs.completeness(records, grid).select("experiment", "invocation", F.array_join("missing", ",").alias("missing"))


def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the arms of each experiment's last complete invocation say against the baseline."""
    records, grid = _records(spark, sf_dir)
    return runs.evidence(records, runs.chosen(runs.completeness(records, grid), grid, "latest"), grid).drop("digest", "metric")


_RECORDS = """
made AS (SELECT 'x' || (user_id % 40) AS experiment, (day(ts) // 10)::VARCHAR AS invocation, event_type AS arm, event_id % 2 AS repetition, ts, user_id AS question, value FROM events),
grid AS (SELECT DISTINCT experiment, arm FROM made),
seen AS (SELECT experiment, invocation, arm, repetition, question, arg_max(value, (ts, value)) AS value, max(ts) AS started FROM made WHERE ts <= TIMESTAMP '2024-01-25 00:00:00' GROUP BY ALL),
known AS (SELECT experiment, invocation, min(started) AS began FROM seen GROUP BY ALL),
cells AS (SELECT k.experiment, k.invocation, k.began, g.arm, r.rep, EXISTS (SELECT 1 FROM seen s WHERE s.experiment = k.experiment AND s.invocation = k.invocation AND s.arm = g.arm AND s.repetition = r.rep) AS ran
    FROM known k JOIN grid g USING (experiment) CROSS JOIN (VALUES (0), (1)) r(rep)),
inv AS (SELECT experiment, invocation, began, coalesce(list_sort(list(arm || '#' || rep) FILTER (NOT ran)), []) AS missing FROM cells GROUP BY ALL),
told AS (SELECT e.experiment, count(i.invocation) AS complete, arg_max(i.invocation, (i.began, i.invocation)) AS last FROM (SELECT DISTINCT experiment FROM grid) e LEFT JOIN inv i ON i.experiment = e.experiment AND len(i.missing) = 0 GROUP BY ALL)"""

PLANS = {
    "ranking_metrics": (ranking_metrics, f"""
        WITH {sql.vectors()}, rel AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 100 = 0),
        m AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
        g AS (SELECT m.query_id, m.n, h.rank + 1 AS spot, row_number() OVER (PARTITION BY m.query_id ORDER BY h.rank) AS i FROM m JOIN rel USING (query_id) JOIN near h ON h.query_id = rel.query_id AND h.node_id = rel.node_id AND h.rank < 10),
        s AS (SELECT query_id, count(*) AS hits, sum(1 / log2(spot + 1)) AS gain, sum(i / spot) AS precise, min(spot) AS first FROM g GROUP BY ALL)
        SELECT m.query_id, coalesce(hits, 0) / 10 AS precision, coalesce(hits, 0) / n AS recall, round(coalesce(precise, 0) / n, 9) AS average_precision,
            round(coalesce(gain, 0) / (SELECT sum(1 / log2(j + 1)) FROM range(1, 11) t(j) WHERE j <= n), 9) AS ndcg, round(coalesce(1 / first, 0), 9) AS reciprocal_rank
        FROM m LEFT JOIN s USING (query_id)"""),
    "answer_metrics": (answer_metrics, f"""
        WITH {_PAIRS}, w AS (SELECT *, {_SQ.format(x='answer')} AS x, {_SQ.format(x='reference')} AS y, regexp_extract_all(lower(answer), '{sql.TOKEN}') AS a, regexp_extract_all(lower(reference), '{sql.TOKEN}') AS b FROM p),
        t AS (SELECT *, string_split(x, ' ') AS xs, string_split(y, ' ') AS ys,
            [a[i] || ' ' || a[i + 1] for i in range(1, len(a))] AS a2, [b[i] || ' ' || b[i + 1] for i in range(1, len(b))] AS b2 FROM w)
        SELECT conv_id, turn, (x = y)::INT::DOUBLE AS exact, contains(x, y)::INT::DOUBLE AS contained,
            {_F1.format(c=_common('xs', 'ys'), a='xs', b='ys')} AS f1,
            round(CASE WHEN len(b) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(b)) ELSE 0.0 END, 9) AS recall,
            round(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 9) AS overlap,
            {_F1.format(c=_common('a', 'b'), a='a', b='b')} AS rouge1, {_F1.format(c=_common('a2', 'b2'), a='a2', b='b2')} AS rouge2 FROM t"""),
    "rouge_longest": (rouge_longest, None),
    "metric_aggregate": (metric_aggregate, f"""
        WITH {_LAB}, s AS (SELECT lang, CASE source WHEN 'src7' THEN 'failed' WHEN 'src8' THEN 'nothing' ELSE 'produced' END AS status, quality AS value FROM l)
        SELECT lang, round(avg(value) FILTER (status = 'produced'), 9) AS mean, count(value) FILTER (status = 'produced') AS n,
            round(CASE WHEN count(value) FILTER (status = 'produced') >= 2 THEN stddev_samp(value) FILTER (status = 'produced') END, 9) AS stdev,
            count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'nothing')::BIGINT AS nothing FROM s GROUP BY lang"""),
    "metric_slices": (metric_slices, f"""
        WITH {_LAB} SELECT 'quality' AS metric, NULL::VARCHAR AS lang, NULL::VARCHAR AS source, round(avg(quality), 9) AS mean, count(quality) AS n FROM l
        UNION ALL SELECT 'quality', lang, NULL, round(avg(quality), 9), count(quality) FROM l WHERE lang IS NOT NULL GROUP BY lang
        UNION ALL SELECT 'quality', NULL, source, round(avg(quality), 9), count(quality) FROM l WHERE source IS NOT NULL GROUP BY source"""),
    "latency_percentile": (latency_percentile, """
        WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, n, max(value) FILTER (k = ceil(0.95 * n) AND k < n) AS value FROM r GROUP BY event_type, n"""),
    "paired_differences": (paired_differences, f"WITH {_LAB} SELECT lang AS metric, count(*) AS n, round(avg(toxic - quality), 9) AS mean, count_if(toxic <> quality)::BIGINT AS differing FROM l GROUP BY lang"),
    "bootstrap": (bootstrap, None),
    "baseline_spread": (baseline_spread, f"""
        WITH {_REPS}, m AS (SELECT metric, rep, avg(value) AS mean FROM r GROUP BY ALL)
        SELECT metric, round(min(mean), 9) AS low, round(max(mean), 9) AS high FROM m GROUP BY metric HAVING count(*) = (SELECT count(DISTINCT rep) FROM r) AND count(*) >= 2"""),
    "replay_oracle": (replay_oracle, f"""
        WITH {_REPS}, a AS (SELECT metric, arm, round(avg(value), 9) AS mean FROM r GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, arm) AS k FROM a),
        q AS (SELECT metric, question_id, max(value) AS v FROM r GROUP BY ALL), o AS (SELECT metric, round(avg(v), 9) AS oracle FROM q GROUP BY metric)
        SELECT metric, arm AS best_arm, mean AS best_mean, oracle FROM b JOIN o USING (metric) WHERE k = 1"""),
    "pairwise_rate": (pairwise_rate, """
        WITH j AS (SELECT CASE WHEN quality = 1 THEN 'a' ELSE 'b' END AS f, CASE WHEN 1 - toxic = 1 THEN 'a' ELSE 'b' END AS g FROM labels), v AS (SELECT CASE WHEN f = g THEN f ELSE 'tie' END AS v FROM j)
        SELECT count(*) AS n, count_if(v = 'b')::BIGINT AS wins, count_if(v = 'a')::BIGINT AS losses, count_if(v = 'tie')::BIGINT AS ties, round((count_if(v = 'b') + 0.5::DOUBLE * count_if(v = 'tie')) / count(*), 9) AS rate FROM v"""),
    "evidence_choice": (evidence_choice, f"""
        WITH {_RECORDS} SELECT experiment, CASE complete WHEN 0 THEN 'incomplete' WHEN 1 THEN 'chosen' ELSE 'ambiguous' END AS outcome, CASE WHEN complete = 1 THEN last END AS invocation, complete FROM told"""),
    "evidence_missing": (evidence_missing, f"WITH {_RECORDS} SELECT experiment, invocation, array_to_string(missing, ',') AS missing FROM inv"),
    "evidence_table": (evidence_table, f"""
        WITH {_RECORDS}, h AS (SELECT s.* FROM seen s JOIN told t ON t.experiment = s.experiment AND t.last = s.invocation WHERE t.complete > 0 AND value IS NOT NULL),
        r AS (SELECT experiment, repetition, avg(value) AS mean FROM h WHERE arm = 'click' GROUP BY ALL),
        sp AS (SELECT experiment, min(mean) AS low, max(mean) AS high, count(*) AS reps FROM r GROUP BY ALL),
        b AS (SELECT experiment, avg(value) AS baseline_mean FROM h WHERE arm = 'click' GROUP BY ALL),
        a AS (SELECT experiment, invocation, arm, avg(value) AS arm_mean FROM h WHERE arm <> 'click' GROUP BY ALL),
        d AS (SELECT x.experiment, x.arm, count(*) AS n, avg(x.value - y.value) AS delta FROM h x JOIN h y ON x.experiment = y.experiment AND x.repetition = y.repetition AND x.question = y.question AND y.arm = 'click' WHERE x.arm <> 'click' GROUP BY ALL)
        SELECT a.experiment, a.invocation, a.arm, round(baseline_mean, 9) AS baseline_mean, round(arm_mean, 9) AS arm_mean, coalesce(n, 0) AS n, round(delta, 9) AS delta, round(low, 9) AS low, round(high, 9) AS high,
            CASE WHEN reps < 2 THEN 'no spread' WHEN abs(delta) > high - low THEN 'beyond spread' WHEN delta IS NOT NULL THEN 'within spread' END AS verdict
        FROM a JOIN b USING (experiment) JOIN sp USING (experiment) LEFT JOIN d ON d.experiment = a.experiment AND d.arm = a.arm"""),
}

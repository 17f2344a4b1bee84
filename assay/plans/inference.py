"""Queries of statistics, calibration, control and reports, over the ``results`` of ``evaluation``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import control, stats
from ..operators import metrics as m
from .evaluation import _RESULTS, results


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _y(c: str = "correct") -> F.Column:
    return F.col(c).cast("double")


# bootstrap and tests

#: Of the one bootstrap that draws rows; those of clusters take stats.RESAMPLES.
ROW_RESAMPLES = 200


def bootstrap_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the accuracy, rows drawn within their type: draws cost resamples times rows, so these are fewer."""
    units = stats.numbered(results(spark, sf).select("doc_id", "type", _y().alias("value"), F.lit(1.0).alias("weight")), F.col("type"), "doc_id")
    return stats.interval(stats.bootstrap(units, "value", "weight", ROW_RESAMPLES))


def bootstrap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the accuracy, whole sources drawn: their sums are taken first."""
    sums = results(spark, sf).groupBy("cluster").agg(F.sum(_y()).alias("value"), F.count("*").cast("double").alias("weight"))
    return stats.interval(stats.bootstrap(stats.numbered(sums, F.lit("all"), "cluster"), "value", "weight"))


def bootstrap_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the F1 of flagging toxic text, sources drawn: 2 tp over 2 tp + fp + fn."""
    flagged = F.col("confidence") < 0.75
    sums = results(spark, sf).groupBy("cluster").agg((2.0 * F.count_if(flagged & F.col("toxic"))).alias("value"), (F.count_if(flagged) + F.count_if("toxic")).cast("double").alias("weight"))
    return stats.interval(stats.bootstrap(stats.numbered(sums, F.lit("all"), "cluster"), "value", "weight"))


def _systems(spark: SparkSession, sf: str) -> DataFrame:
    """Two systems on the same rows: one calls a text good by its share of letters, the other by its length."""
    rows = results(spark, sf)
    return rows.select("doc_id", "type", "cluster", "correct", (F.col("confidence") >= 0.79).alias("a"), (F.col("n_chars") >= 1200).alias("b"))


def paired_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _systems(spark, sf).select((F.col("a") == F.col("correct")).cast("double").alias("x"), (F.col("b") == F.col("correct")).cast("double").alias("y"))
    return stats.outcomes(rows, "x", "y")


def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    right_a, right_b = F.col("a") == F.col("correct"), F.col("b") == F.col("correct")
    one = _systems(spark, sf).agg(F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b")).first()
    p = round(stats.mcnemar(one["only_a"], one["only_b"]), 6)
    return spark.createDataFrame([(one["only_a"], one["only_b"], p)], "only_a long, only_b long, p double")


def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the difference in accuracy and how often the first system is ahead, draws shared by both."""
    delta = (F.col("a") == F.col("correct")).cast("double") - (F.col("b") == F.col("correct")).cast("double")
    sums = _systems(spark, sf).groupBy("cluster").agg(F.sum(delta).alias("value"), F.count("*").cast("double").alias("weight"))
    drawn = stats.bootstrap(stats.numbered(sums, F.lit("all"), "cluster"), "value", "weight")
    return stats.interval(drawn).crossJoin(drawn.agg(F.round(F.avg((F.col("estimate") > 0).cast("double")), 6).alias("ahead")))  # one row each


def kappa(spark: SparkSession, sf: str) -> DataFrame:
    return stats.kappa(_systems(spark, sf), "a", "b").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


# calibration


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return stats.hash_split(results(spark, sf), "doc_id", "type", 0.5).select("doc_id", "type", "part")


def temperature(spark: SparkSession, sf: str) -> DataFrame:
    return stats.temperature(results(spark, sf)).select(F.round("temperature", 6).alias("temperature"), F.round("nll", 6).alias("nll"))


def platt(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score before and after, fitted on one half and applied to both."""
    split = stats.hash_split(results(spark, sf), "doc_id", "type", 0.5)
    a, b = stats.platt(split.filter("part = 'calibration'"))
    after = stats.sigmoid(a * stats.logit(F.col("confidence")) + b)
    square = lambda p: F.avg((p - _y()) * (p - _y()))
    return split.groupBy("part").agg(F.count("*").alias("n"), F.round(square(F.col("confidence")), 6).alias("before"), F.round(square(after), 6).alias("after"))


def threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    """The confidence at which telling good texts has the best F1 with a precision of .55 or more."""
    rows = stats.thresholds(results(spark, sf), "confidence", "correct").filter("precision >= 0.55")
    best = rows.agg(F.max(F.struct(F.round("f1", 6).alias("f1"), (-F.col("threshold")).alias("t"), "tp", "fp", "fn")).alias("m"))
    return best.select((-F.col("m.t")).alias("threshold"), "m.f1", "m.tp", "m.fp", "m.fn")


def balance(spark: SparkSession, sf: str) -> DataFrame:
    """Oversampling: rows of the rarer label are repeated until both have about as many."""
    counts = results(spark, sf).groupBy("correct").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    times = counts.crossJoin(most).select("correct", F.floor(F.col("most") / F.col("n")).cast("int").alias("times"))  # two rows
    rows = results(spark, sf).join(F.broadcast(times), "correct").select("correct", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return rows.groupBy("correct").agg(F.count("*").alias("n"), F.max("copy").cast("long").alias("copies"))


# control


def _uncertain(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("confidence")
    parts = {
        "retrieval": F.least(F.lit(1.0), 500.0 / (F.col("n_chars") + 1)),
        "evidence": 1 - c,
        "conflict": F.when(F.col("toxic"), 0.9).otherwise(0.1),
        "reasoning": F.when(F.col("difficulty") == "hard", 0.8).otherwise(0.2),
        "knowledge": F.when(F.col("correct"), 0.1).otherwise(0.9),
    }
    rows = results(spark, sf).select("doc_id", "confidence", "type", "cluster", *[v.alias(k) for k, v in parts.items()])
    return rows.withColumn("total", F.round(control.overall(*[F.col(p) for p in control.PARTS]), 6))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _uncertain(spark, sf)
    return rows.groupBy(control.action(F.col("total"), F.col("conflict"), F.col("retrieval"), F.lit(0)).alias("action")).agg(F.count("*").alias("n"), F.round(F.avg("total"), 6).alias("total"))


def answer_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    rows = _uncertain(spark, sf)
    later = control.at_answer(F.col("total"), F.col("confidence"))
    return rows.select("doc_id", "total", F.round(later, 6).alias("at_answer"), F.round(control.calibrated(F.col("confidence"), F.col("total"), F.lit(0.05)), 6).alias("calibrated"))


def question_analysis(spark: SparkSession, sf: str) -> DataFrame:
    found = control.analysis(F.col("text"))
    return _table(spark, sf, "conversations").filter("role = 'user'").groupBy(found["complexity"].alias("complexity"), found["hops"].cast("long").alias("hops")).agg(F.count("*").alias("n"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as claims of an order: returned refutes, accepted supports, else open."""
    status = F.when(F.col("l_returnflag") == "R", "refuted").when(F.col("l_returnflag") == "A", "supported").otherwise("not_enough_info")
    return control.verdicts(_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), status.alias("status")), "order_id")


def ignored_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive parts of an order of which no large line cites either."""
    lines = _table(spark, sf, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pairs = lines.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b")).filter("b is not null")
    cited = lines.filter("l_quantity >= 45").select(F.col("l_partkey").alias("id"))
    return control.ignored(pairs.distinct(), cited).select("a", "b")


# reports and history


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with at least three results, best accuracy first, then lower Brier score."""
    by = results(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg(_y()), 6).alias("accuracy"), F.round(m.brier(), 6).alias("brier")).filter("n >= 3")
    order = Window.orderBy(F.desc("accuracy"), "brier", "cluster")  # a row for each system
    return by.withColumn("rank", F.row_number().over(order).cast("long"))


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two reports of the same rows, by type."""
    rows = _systems(spark, sf)
    a, b = F.avg((F.col("a") == F.col("correct")).cast("double")), F.avg((F.col("b") == F.col("correct")).cast("double"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(a - b, 6).alias("delta"))


def merged_report(spark: SparkSession, sf: str) -> DataFrame:
    """Disjoint parts put together again, with the number of ids that are missing, doubled or unknown."""
    rows = results(spark, sf)
    parts = rows.filter("type = 'en'").unionByName(rows.filter("type <> 'en'"))
    by = parts.groupBy("doc_id").agg(F.count("*").alias("times"))
    asked = _table(spark, sf, "labels").select("doc_id", F.lit(1).alias("asked"))
    both = asked.join(by, "doc_id", "full")
    return both.agg(F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("times") > 1).alias("doubled"), F.count_if(F.col("asked").isNull()).alias("unknown"), F.count("*").alias("ids"))


def group_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Each type's accuracy against that of all."""
    rows = results(spark, sf)
    full = rows.agg(F.avg(_y()).alias("all"))
    return rows.groupBy("type").agg(F.avg(_y()).alias("accuracy")).crossJoin(full).select("type", F.round("accuracy", 6).alias("accuracy"), F.round(F.col("accuracy") - F.col("all"), 6).alias("delta"))


def checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Last write wins: the newest event of each user and type, of those not in error."""
    events = _table(spark, sf, "events").filter("event_type <> 'error'")
    last = events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "event_type", "e.event_id", "e.value")


def status(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("ids"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


def history_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of twenty, newest first."""
    return _table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).offset(40).limit(20).select("event_id", "user_id", "event_type")


def todo(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose run has to be repeated: no order, or only open ones."""
    done = _table(spark, sf, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def json_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Top-level members of each event's properties, by path and type."""
    leaves = _table(spark, sf, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    number = F.expr("try_cast(value as double)")
    return leaves.groupBy(F.concat(F.lit("$."), "name").alias("path"), number.isNotNull().alias("numeric")).agg(F.count("*").alias("n"), F.round(F.sum(number), 6).alias("total"))


def violations(spark: SparkSession, sf: str) -> DataFrame:
    """All rule breaches of the order tables as (entity, rule, n)."""
    orders, lines = _table(spark, sf, "orders"), _table(spark, sf, "lineitem")
    found = [
        orders.filter("o_totalprice <= 0 or o_totalprice is null").select(F.lit("orders").alias("entity"), F.lit("price").alias("rule")),
        lines.filter("l_discount > 0.09").select(F.lit("lineitem"), F.lit("discount")),
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left_anti").select(F.lit("lineitem"), F.lit("order")),
        orders.join(lines, lines["l_orderkey"] == orders["o_orderkey"], "left_anti").select(F.lit("orders"), F.lit("empty")),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return every.groupBy("entity", "rule").agg(F.count("*").alias("n"))


_DRAW = "(('0x' || substr(md5('1729:' || r || ':' || stratum || ':' || k), 1, 8))::BIGINT % n) + 1"
_SYSTEMS = f"{_RESULTS}, systems AS (SELECT doc_id, type, cluster, correct, confidence >= 0.79 AS a, n_chars >= 1200 AS b FROM results)"


def _bootstrap_sql(units: str, extra: str = "", resamples: int = stats.RESAMPLES) -> str:
    """``units``: SELECT of stratum, i, value, weight."""
    return f"""units AS ({units}), sizes AS (SELECT stratum, count(*) AS n FROM units GROUP BY 1),
draws AS (SELECT r, stratum, {_DRAW} AS i FROM sizes, range({resamples}) AS a(r), LATERAL (SELECT unnest(range(1, n + 1)) AS k)),
estimates AS (SELECT r, sum(value) / sum(weight) AS estimate FROM draws JOIN units USING (stratum, i) GROUP BY 1)
SELECT count(*) AS resamples, round(quantile_cont(estimate, 0.025), 6) AS lower, round(quantile_cont(estimate, 0.975), 6) AS upper{extra} FROM estimates"""


def _clusters(value: str, weight: str, source: str = "results") -> str:
    return f"SELECT 'all' AS stratum, row_number() OVER (ORDER BY cluster) AS i, value, weight FROM (SELECT cluster, ({value})::DOUBLE AS value, ({weight})::DOUBLE AS weight FROM {source} GROUP BY 1)"


_UNCERTAIN = f"""{_RESULTS}, parts AS (SELECT doc_id, confidence, least(1.0::DOUBLE, 500.0::DOUBLE / (n_chars + 1)) AS retrieval, 1 - confidence AS evidence,
  CASE WHEN toxic THEN 0.9 ELSE 0.1 END::DOUBLE AS conflict, CASE WHEN difficulty = 'hard' THEN 0.8 ELSE 0.2 END::DOUBLE AS reasoning, CASE WHEN correct THEN 0.1 ELSE 0.9 END::DOUBLE AS knowledge FROM results),
uncertain AS (SELECT *, round(0.25::DOUBLE * retrieval + 0.30::DOUBLE * evidence + 0.20::DOUBLE * conflict + 0.15::DOUBLE * reasoning + 0.10::DOUBLE * knowledge, 6) AS total FROM parts)"""


def _mark(name: str) -> str:
    return f"regexp_matches(text, '{control.MARKS[name]}')::INT"


QUERIES = {
    "t3_bootstrap_stratified": bootstrap_stratified,
    "t4_bootstrap_clusters": bootstrap_clusters,
    "t5_bootstrap_f1": bootstrap_f1,
    "t6_paired_outcomes": paired_outcomes,
    "t7_mcnemar": mcnemar,
    "t8_paired_bootstrap": paired_bootstrap,
    "t9_kappa": kappa,
    "k1_hash_split": hash_split,
    "k2_platt": platt,
    "k3_temperature": temperature,
    "k7_threshold_search": threshold_search,
    "k8_balance": balance,
    "u1_question_analysis": question_analysis,
    "u8_answer_uncertainty": answer_uncertainty,
    "u9_decisions": decisions,
    "u16_verdicts": verdicts,
    "u17_ignored_conflicts": ignored_conflicts,
    "p2_merged_report": merged_report,
    "p4_comparison": comparison,
    "p5_leaderboard": leaderboard,
    "m41_group_deltas": group_deltas,
    "s11_violations": violations,
    "s12_json_leaves": json_leaves,
    "s14_checkpoint": checkpoint,
    "s14_todo": todo,
    "s16_status": status,
    "s18_history_page": history_page,
}
ORACLES = {
    "t3_bootstrap_stratified": f"WITH {_RESULTS}, {_bootstrap_sql('SELECT type AS stratum, row_number() OVER (PARTITION BY type ORDER BY doc_id) AS i, correct::INT::DOUBLE AS value, 1.0::DOUBLE AS weight FROM results', resamples=ROW_RESAMPLES)}",
    "t4_bootstrap_clusters": f"WITH {_RESULTS}, {_bootstrap_sql(_clusters('sum(correct::INT)', 'count(*)'))}",
    "t5_bootstrap_f1": f"WITH {_RESULTS}, {_bootstrap_sql(_clusters('2 * count(*) FILTER (WHERE confidence < 0.75 AND toxic)', 'count(*) FILTER (WHERE confidence < 0.75) + count(*) FILTER (WHERE toxic)'))}",
    "t6_paired_outcomes": f"WITH {_SYSTEMS} SELECT count(*) FILTER (WHERE a = correct AND b <> correct) AS wins, count(*) FILTER (WHERE (a = correct) = (b = correct)) AS ties, count(*) FILTER (WHERE a <> correct AND b = correct) AS losses FROM systems",
    "t7_mcnemar": f"""WITH {_SYSTEMS}, c AS (SELECT count(*) FILTER (WHERE a = correct AND b <> correct) AS only_a, count(*) FILTER (WHERE a <> correct AND b = correct) AS only_b FROM systems),
tail AS (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) AS t FROM c, LATERAL (SELECT unnest(range(0, least(only_a, only_b) + 1)) AS i))
SELECT only_a, only_b, round(least(1, 2 * t), 6)::DOUBLE AS p FROM c, tail""",
    "t8_paired_bootstrap": f"WITH {_SYSTEMS}, {_bootstrap_sql(_clusters('sum((a = correct)::INT - (b = correct)::INT)', 'count(*)', 'systems'), ', round(avg((estimate > 0)::INT), 6) AS ahead')}",
    "t9_kappa": f"""WITH {_SYSTEMS}, s AS (SELECT count(*) AS n, avg((a = b)::INT) AS agreement, avg(a::INT) * avg(b::INT) + (1 - avg(a::INT)) * (1 - avg(b::INT)) AS expected FROM systems)
SELECT n, round(agreement, 6) AS agreement, round(CASE WHEN expected = 1 THEN 1 ELSE (agreement - expected) / (1 - expected) END, 6)::DOUBLE AS kappa FROM s""",
    "k1_hash_split": f"""WITH {_RESULTS}, o AS (SELECT doc_id, type, row_number() OVER (PARTITION BY type ORDER BY sha256('1729:' || doc_id)) AS r, count(*) OVER (PARTITION BY type) AS n FROM results)
SELECT doc_id, type, CASE WHEN r <= greatest(1, least(n - 1, round(n * 0.5::DOUBLE)::BIGINT)) THEN 'calibration' ELSE 'holdout' END AS part FROM o""",
    "k3_temperature": f"""WITH {_RESULTS}, grid AS (SELECT i, exp(ln(0.05::DOUBLE) + i * (ln(10.0::DOUBLE / 0.05::DOUBLE) / 159)) AS t FROM range(160) AS g(i)),
c AS (SELECT greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, confidence)) AS q, correct FROM results),
p AS (SELECT i, t, correct, greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, 1 / (1 + exp(-(ln(q / (1 - q)) / t))))) AS p FROM c, grid),
n AS (SELECT i, t, round(avg(CASE WHEN correct THEN -ln(p) ELSE -ln(1 - p) END), 9) AS nll FROM p GROUP BY 1, 2)
SELECT round(t, 6) AS temperature, round(nll, 6) AS nll FROM n ORDER BY n.nll, i LIMIT 1""",
    "k7_threshold_search": f"""WITH {_RESULTS}, b AS (SELECT confidence AS threshold, count(*) FILTER (WHERE correct) AS p, count(*) FILTER (WHERE NOT correct) AS n FROM results GROUP BY 1),
r AS (SELECT threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS every FROM b WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT threshold, round(2 * tp / (tp + fp + every)::DOUBLE, 6) AS f1, tp, fp, every - tp AS fn FROM r WHERE tp / (tp + fp)::DOUBLE >= 0.55 ORDER BY 2 DESC, threshold LIMIT 1""",
    "k8_balance": f"WITH {_RESULTS}, c AS (SELECT correct, count(*) AS n FROM results GROUP BY 1), t AS (SELECT correct, n, (SELECT max(n) FROM c) // n AS copies FROM c) SELECT correct, n * copies AS n, copies FROM t",
    "u1_question_analysis": f"""WITH s AS (SELECT {' + '.join(_mark(k) for k in control.MARKS)} + (length(text) > 200)::INT AS c FROM conversations WHERE role = 'user')
SELECT CASE WHEN c = 0 THEN 'low' WHEN c <= 2 THEN 'medium' ELSE 'high' END AS complexity, (CASE WHEN c = 0 THEN 1 WHEN c <= 2 THEN 2 ELSE 4 END)::BIGINT AS hops, count(*) AS n FROM s GROUP BY 1, 2""",
    "u8_answer_uncertainty": f"""WITH {_UNCERTAIN} SELECT doc_id, total, round(greatest(0, least(1, total + CASE WHEN confidence > 0.8 AND total > 0.5 THEN 0.2 ELSE 0 END::DOUBLE)), 6) AS at_answer,
  round(greatest(0, least(1, confidence * (1 - 0.35::DOUBLE * greatest(0, least(1, total))) - 0.05::DOUBLE)), 6) AS calibrated FROM uncertain""",
    "u9_decisions": f"""WITH {_UNCERTAIN} SELECT CASE WHEN total > 0.7 THEN 'abstain' WHEN conflict > 0.6 THEN 'resolve_conflict' WHEN retrieval > 0.6 THEN 'retrieve_more' WHEN total > 0.3 THEN 'refine' ELSE 'proceed' END AS action,
  count(*) AS n, round(avg(total), 6) AS total FROM uncertain GROUP BY 1""",
    "u16_verdicts": """WITH c AS (SELECT l_orderkey AS order_id, count(*) FILTER (WHERE l_returnflag = 'A') AS supported, count(*) FILTER (WHERE l_returnflag = 'R') AS refuted, count(*) AS n FROM lineitem GROUP BY 1)
SELECT order_id, CASE WHEN refuted > 0 THEN 'refuted' WHEN supported = n THEN 'supported' ELSE 'not_enough_info' END AS status, supported, refuted, n - supported - refuted AS open FROM c""",
    "u17_ignored_conflicts": """WITH pairs AS (SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS b FROM lineitem) WHERE b IS NOT NULL),
cited AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity >= 45)
SELECT a, b FROM pairs WHERE a NOT IN (SELECT id FROM cited) AND b NOT IN (SELECT id FROM cited)""",
    "p2_merged_report": f"""WITH {_RESULTS}, t AS (SELECT doc_id, count(*) AS times FROM results GROUP BY 1)
SELECT count(*) FILTER (WHERE times IS NULL) AS missing, count(*) FILTER (WHERE times > 1) AS doubled, count(*) FILTER (WHERE asked IS NULL) AS unknown, count(*) AS ids FROM (SELECT doc_id, 1 AS asked FROM labels) FULL JOIN t USING (doc_id)""",
    "p4_comparison": f"WITH {_SYSTEMS} SELECT type, count(*) AS n, round(avg((a = correct)::INT), 6) AS a, round(avg((b = correct)::INT), 6) AS b, round(avg((a = correct)::INT) - avg((b = correct)::INT), 6) AS delta FROM systems GROUP BY 1",
    "p5_leaderboard": f"""WITH {_RESULTS}, c AS (SELECT cluster, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(pow(confidence - correct::INT::DOUBLE, 2)), 6) AS brier FROM results GROUP BY 1 HAVING count(*) >= 3)
SELECT *, row_number() OVER (ORDER BY accuracy DESC, brier, cluster) AS rank FROM c""",
    "m41_group_deltas": f"WITH {_RESULTS} SELECT type, round(avg(correct::INT), 6) AS accuracy, round(avg(correct::INT) - (SELECT avg(correct::INT) FROM results), 6) AS delta FROM results GROUP BY 1",
    "s11_violations": """SELECT entity, rule, count(*) AS n FROM (
  SELECT 'orders' AS entity, 'price' AS rule FROM orders WHERE o_totalprice <= 0 OR o_totalprice IS NULL
  UNION ALL SELECT 'lineitem', 'discount' FROM lineitem WHERE l_discount > 0.09
  UNION ALL SELECT 'lineitem', 'order' FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'orders', 'empty' FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1, 2""",
    "s12_json_leaves": """WITH l AS (SELECT unnest(json_keys(props)) AS name, props FROM events), v AS (SELECT name, try_cast(json_extract_string(props, '$.' || name) AS DOUBLE) AS v FROM l)
SELECT '$.' || name AS path, v IS NOT NULL AS numeric, count(*) AS n, round(sum(v), 6) AS total FROM v GROUP BY 1, 2""",
    "s14_checkpoint": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'error') WHERE r = 1",
    "s14_todo": "SELECT c_custkey, c_mktsegment FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O') ON c_custkey = o_custkey",
    "s16_status": "SELECT count(*) AS rows, count(DISTINCT user_id) AS ids, count(*) FILTER (WHERE event_type = 'error') AS errors, (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_id FROM events",
    "s18_history_page": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40",
}

"""Plans of subquestions: made, put in order, revised.

A plan is an array of steps in its question's row (``STEP``), the column ``plan``; it has at most MOST of them. Putting it in order drops blank steps, numbers the
rest ``sq0``, ``sq1``, ... and keeps of the dependencies those on earlier steps, so that no plan has a cycle. ``levels`` takes any
graph of steps as a table: it removes what is unknown, and finds the levels frontier by frontier; steps on or behind a cycle have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import saved

MOST, KEYWORDS = 10, 5
STEP = "struct<id:string,question:string,evidence:string,deps:array<string>,counter:boolean,status:string,coverage:double>"
# Texts and thresholds of plans.
ABOUT = ("What information is available about '", "' in the context of this question?")
FALLBACK = "Gather enough evidence to answer the original question"
RESOLVE = ("Resolve conflicting evidence about ", " relationships")
VERIFY = "Find high-credibility sources to verify key claims"
RESOLVED, OPEN, UNSURE = 0.8, 0.5, 0.5


def step(id_: Column, question: Column, evidence: str = "general", deps: Column | None = None, counter: Column | None = None, status: str = "pending") -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        id_.alias("id"), question.alias("question"), F.lit(evidence).alias("evidence"), (none if deps is None else deps).alias("deps"),
        (F.lit(False) if counter is None else F.coalesce(counter, F.lit(False))).alias("counter"), F.lit(status).alias("status"), F.lit(0.0).alias("coverage"),
    ).cast(STEP)


def _number(i: Column) -> Column:
    return F.concat(F.lit("sq"), i.cast("string"))


def _no_deps() -> Column:
    return F.array().cast("array<string>")


def ordered(rows: DataFrame, fallback: Column, counter: Column | None = None, most: int = MOST) -> DataFrame:
    """``rows`` with their ``plan`` in order; one step with the fallback question where no step has a question."""
    if most < 1:
        raise ValueError("a plan has at least one step")
    rows = rows.withColumn("_kept", F.slice(F.filter("plan", lambda s: F.trim(s["question"]) != ""), 1, most))
    rows = rows.withColumn("_numbers", F.transform("_kept", lambda s, i: F.struct(s["id"].alias("old"), _number(i).alias("new"))))
    # of steps of one id the last is meant
    known = lambda d: F.coalesce(F.try_element_at(F.filter("_numbers", lambda n: n["old"] == d), F.lit(-1))["new"], d)
    # a step's number is its place, so the earlier ones are those of smaller numbers
    earlier = lambda d, i: F.coalesce(F.regexp_extract(d, r"^sq(0|[1-9][0-9]{0,8})$", 1).try_cast("int") < i, F.lit(False))
    steps = F.transform(
        "_kept",
        lambda s, i: F.struct(
            _number(i).alias("id"), F.trim(s["question"]).alias("question"), F.coalesce(F.nullif(s["evidence"], F.lit("")), F.lit("general")).alias("evidence"),
            F.array_distinct(F.filter(F.transform(F.coalesce(s["deps"], _no_deps()), known), lambda d: earlier(d, i))).alias("deps"),
            F.coalesce(s["counter"], F.lit(False)).alias("counter"), F.coalesce(s["status"], F.lit("pending")).alias("status"), F.coalesce(s["coverage"], F.lit(0.0)).alias("coverage"),
        ),
    ).cast(f"array<{STEP}>")
    only = F.array(step(F.lit("sq0"), F.coalesce(F.nullif(F.trim(fallback), F.lit("")), F.lit(FALLBACK)), counter=counter))
    return rows.withColumn("plan", F.when(F.size("_kept") > 0, steps).otherwise(only)).drop("_kept", "_numbers")


def decomposed(rows: DataFrame, question: Column, keywords: Column, simple: Column, counter: Column, most: int = MOST) -> DataFrame:
    """``rows`` with a ``plan`` for their question: itself where it is simple, else a step for each of its first keywords and one that draws on them all."""
    rows = rows.withColumn("_first", F.when(simple, _no_deps()).otherwise(F.slice(F.coalesce(keywords, _no_deps()), 1, KEYWORDS)))
    asked = F.transform("_first", lambda w, i: step(_number(i), F.concat(F.lit(ABOUT[0]), w, F.lit(ABOUT[1])), counter=counter))
    last = step(_number(F.size("_first")), question, "synthesis", F.transform("_first", lambda w, i: _number(i)))
    alone = F.array(step(F.lit("sq0"), question, counter=counter))
    return ordered(rows.withColumn("plan", F.when(simple, alone).otherwise(F.concat(asked, F.array(last)))).drop("_first"), question, counter, most)


def covered(rows: DataFrame, coverage: Column) -> DataFrame:
    """``rows`` with the coverage of their plan's steps, given in their order; 0 where it is not given."""
    return rows.withColumn("plan", F.transform("plan", lambda s, i: s.withField("coverage", F.coalesce(F.get(coverage, i), F.lit(0.0)))))


def revised(rows: DataFrame, retrieval: Column, conflict: Column, source: Column, conflicts: Column, most: int = MOST) -> DataFrame:
    """``rows`` with their plan after a round: covered steps are resolved, open ones are taken up again where retrieval is unsure; a step for each kind of
    conflict, in alphabetical order, waits for what is not resolved; and where sources are unsure, one verifies."""
    status = lambda s: F.when(s["coverage"] >= RESOLVED, "resolved").when((retrieval > UNSURE) & (s["coverage"] < OPEN) & (s["status"] != "resolved"), "in_progress").otherwise(s["status"])
    rows = ordered(rows, F.lit(FALLBACK), most=most)
    rows = rows.withColumn("plan", F.transform("plan", lambda s: s.withField("status", status(s))))
    kinds = F.array_sort(F.array_distinct(F.coalesce(conflicts, _no_deps())))
    rows = rows.withColumn("_kinds", F.slice(F.when(conflict > UNSURE, kinds).otherwise(_no_deps()), F.lit(1), F.greatest(F.lit(0), most - F.size("plan"))))
    rows = rows.withColumn("_waiting", F.transform(F.filter("plan", lambda s: s["status"] != "resolved"), lambda s: s["id"]))
    # each of these waits for those before it as well
    resolve = lambda kind, i: step(
        F.concat(F.lit("sq_resolve_"), kind), F.concat(F.lit(RESOLVE[0]), kind, F.lit(RESOLVE[1])), deps=F.concat("_waiting", F.transform(F.slice("_kinds", F.lit(1), i), lambda k: F.concat(F.lit("sq_resolve_"), k)))
    )
    rows = rows.withColumn("plan", F.concat("plan", F.transform("_kinds", resolve)))
    verify = step(F.lit("sq_source_verify"), F.lit(VERIFY), "empirical_study", F.slice(F.transform("plan", lambda s: s["id"]), 1, 3))
    rows = rows.withColumn("plan", F.when((source > UNSURE) & (F.size("plan") < most), F.concat("plan", F.array(verify))).otherwise(F.col("plan")))
    return ordered(rows.drop("_kinds", "_waiting"), F.lit(FALLBACK), most=most)


def steps_of(plans: DataFrame, key: str, plan: str = "plan") -> DataFrame:
    """A row a step: key, place, and the fields of the step."""
    return plans.select(key, F.posexplode(plan).alias("place", "step")).select(key, "place", "step.*")


def levels(steps: DataFrame, key: str, id_: str = "id", deps: str = "deps") -> DataFrame:
    """(key, id, level) of a table of steps: 0 without dependencies, else one more than the highest of them; null on or behind a cycle.

    Dependencies that are no steps of their question, and of a step on itself, are left out. Each round is a join with the last frontier.
    """
    nodes = saved(steps.select(F.col(key).alias("q"), F.col(id_).alias("id"), F.col(deps).alias("deps")), "steps")
    known = nodes.select("q", F.col("id").alias("dep")).distinct()
    edges = nodes.select("q", "id", F.explode("deps").alias("dep")).filter("id <> dep").distinct().join(known, ["q", "dep"])
    edges = saved(edges, "edges")
    frontier = saved(nodes.select("q", "id").distinct().join(edges, ["q", "id"], "left_anti"), "frontier")
    done, level = [frontier.withColumn("level", F.lit(0))], 0
    while not edges.isEmpty():
        left = saved(edges.join(frontier.withColumnRenamed("id", "dep"), ["q", "dep"], "left_anti"), "edges")
        frontier = saved(edges.join(frontier.withColumnRenamed("id", "dep"), ["q", "dep"], "left_semi").select("q", "id").distinct().join(left, ["q", "id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        edges, level = left, level + 1
        done.append(frontier.withColumn("level", F.lit(level)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    placed = nodes.select("q", "id").distinct().join(out, ["q", "id"], "left")
    return placed.select(F.col("q").alias(key), F.col("id").alias(id_), "level")

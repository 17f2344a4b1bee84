"""Plans and the history table."""

import datetime

import pytest
from pyspark.sql import functions as F

from assay.operators import planning as p
from assay.sources.history import History, shortened

TYPE = f"q int, plan array<{p.STEP}>, retrieval double, conflict double, source double, conflicts array<string>"


def step(id_, question="q", deps=(), coverage=0.0, status="pending", evidence="general", counter=False):
    return (id_, question, evidence, list(deps), counter, status, coverage)


def revised(spark, steps, retrieval=0.0, conflict=0.0, source=0.0, conflicts=None, most=p.MOST):
    rows = spark.createDataFrame([(1, steps, retrieval, conflict, source, conflicts)], TYPE)
    return p.revised(rows, F.col("retrieval"), F.col("conflict"), F.col("source"), F.col("conflicts"), most).first()["plan"]


def ordered(spark, steps, fallback="What now?", most=p.MOST):
    rows = spark.createDataFrame([(1, steps, 0.0, 0.0, 0.0, None)], TYPE)
    return p.ordered(rows, F.lit(fallback), F.lit(True), most).first()["plan"]


def test_order(spark):
    got = ordered(spark, [step("a", "one", ["b"]), step("x", "  "), step("b", " two ", ["a", "a", "nowhere", "b"]), step("c", "three", ["sq0", "b", "x"])])
    assert [(s["id"], s["question"], s["deps"]) for s in got] == [("sq0", "one", []), ("sq1", "two", ["sq0"]), ("sq2", "three", ["sq0", "sq1"])]
    # of steps of one id the last is meant; a step may not wait for itself or for a later one
    got = ordered(spark, [step("a"), step("a"), step("z", deps=["a", "sq2", "sq3"])])
    assert got[2]["deps"] == ["sq1"]
    assert [s["id"] for s in ordered(spark, [step(str(i)) for i in range(20)], most=3)] == ["sq0", "sq1", "sq2"]


def test_order_of_nothing(spark):
    for steps in ([], [step("a", " ")]):
        only = ordered(spark, steps)
        assert len(only) == 1 and (only[0]["id"], only[0]["question"], only[0]["counter"]) == ("sq0", "What now?", True)
    assert ordered(spark, [], " ")[0]["question"] == p.FALLBACK
    with pytest.raises(ValueError):
        ordered(spark, [], most=0)


def test_decomposition(spark):
    rows = spark.createDataFrame([("Why?", ["a", "b"], False), ("Why?", [], True), ("Why?", None, False), ("Why?", list("abcdefg"), False)], "q string, w array<string>, simple boolean")
    many, simple, none, capped = (r["plan"] for r in p.decomposed(rows, F.col("q"), F.col("w"), F.col("simple"), F.lit(True)).collect())
    assert [s["deps"] for s in many] == [[], [], ["sq0", "sq1"]] and many[2]["evidence"] == "synthesis" and many[0]["question"] == "a".join(p.ABOUT)
    assert [s["question"] for s in simple] == ["Why?"] == [s["question"] for s in none]
    assert len(capped) == p.KEYWORDS + 1


def test_revision(spark):
    got = revised(spark, [step("sq0", coverage=0.2), step("sq1", coverage=0.9), step("sq2", coverage=0.6)], retrieval=0.8)
    assert [s["status"] for s in got] == ["in_progress", "resolved", "pending"]
    got = revised(spark, [step("sq0", coverage=0.7)], conflict=0.8, conflicts=["temporal", "causal", "temporal"])
    assert [s["question"] for s in got[1:]] == ["causal".join(p.RESOLVE), "temporal".join(p.RESOLVE)]
    assert [s["deps"] for s in got] == [[], ["sq0"], ["sq0", "sq1"]]
    assert len(revised(spark, [step("sq0", coverage=0.7)], conflict=0.8)) == 1
    got = revised(spark, [step("sq0", coverage=0.9), step("sq1")], source=0.6)
    assert (got[2]["evidence"], got[2]["deps"], got[2]["question"]) == ("empirical_study", ["sq0", "sq1"], p.VERIFY)
    got = revised(spark, [step(f"sq{i}", coverage=0.3) for i in range(4)], conflict=0.9, source=0.9, conflicts=["a", "b", "c"], most=5)
    assert len(got) == 5 and got[4]["question"] == "a".join(p.RESOLVE)
    steps = [step("sq0", "one", status="done", coverage=0.5)]
    assert [tuple(s)[:6] for s in revised(spark, steps)] == [("sq0", "one", "general", [], False, "done")]


def test_levels_of_any_graph(spark):
    rows = [
        (1, "a", []), (1, "b", ["a", "a", "gone"]), (1, "c", ["a", "b"]), (1, "d", ["d"]),
        (2, "a", ["b"]), (2, "b", ["a"]), (2, "c", ["b"]), (2, "e", None), (2, "f", ["e"]), (3, "a", ["b"]),
    ]
    got = p.levels(spark.createDataFrame(rows, "q int, id string, deps array<string>"), "q").collect()
    want = {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (2, "a"): None, (2, "b"): None, (2, "c"): None, (2, "e"): 0, (2, "f"): 1, (3, "a"): 0}
    assert {(r["q"], r["id"]): r["level"] for r in got} == want
    assert p.levels(spark.createDataFrame([], "q int, id string, deps array<string>"), "q").count() == 0


SCHEMA = "id string, answer string, created_at timestamp"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_history(spark, tmp_path):
    table = History(spark, str(tmp_path / "h"), SCHEMA)
    rows = lambda *r: spark.createDataFrame([(i, a, at(m)) for i, a, m in r], SCHEMA)
    ids = lambda frame: [r["id"] for r in frame.collect()]
    assert table.state().count() == 0 and ids(table.page()) == [] and ids(table.get("a")) == []
    table.insert(rows(("a", "1", 1), ("b", "2", 3), ("c", "3", 3)))
    with pytest.raises(ValueError):
        table.insert(rows(("b", "x", 9)))
    with pytest.raises(ValueError):
        table.insert(rows(("n", "x", 9), ("n", "y", 9)))
    table.put(rows(("b", "4", 3), ("d", "5", 2)))
    assert table.get("b").first()["answer"] == "4" and table.get("a").first()["answer"] == "1"
    assert ids(table.page()) == ["b", "c", "d", "a"] and ids(table.page(2, 1)) == ["c", "d"] and ids(table.page(0)) == []
    gone = spark.createDataFrame([("b",), ("b",), ("nobody",)], "id string")
    assert table.delete(gone) == 1 and table.delete(gone) == 0
    assert ids(table.get("b")) == [] and sorted(ids(table.state())) == ["a", "c", "d"]
    before = ids(table.page())
    table.compact()
    assert ids(table.page()) == before and len(table._commits()) == 1 and table.get("d").first()["answer"] == "5"
    table.insert(rows(("b", "6", 0)))
    assert ids(table.page()) == [*before, "b"]
    with pytest.raises(ValueError):
        table.page(-1)


def test_a_point_get_reads_one_bucket(spark, tmp_path):
    table = History(spark, str(tmp_path / "h"), SCHEMA)
    table.put(spark.range(200).select(F.col("id").cast("string"), F.lit("x").alias("answer"), F.lit(at(1)).alias("created_at")))
    found = table.get("17")
    assert found.count() == 1
    buckets = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()} if found.inputFiles() else set()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and len(buckets) <= 16


def test_a_commit_without_its_line_does_not_count(spark, tmp_path):
    table = History(spark, str(tmp_path / "h"), SCHEMA)
    row = lambda i: spark.createDataFrame([(i, "x", at(1))], SCHEMA)
    table.put(row("a"))
    row("lost").selectExpr("*", "'put' op", "0L seq", "3 bucket").write.partitionBy("bucket").parquet(str(tmp_path / "h/data/commit=7"))
    assert [r["id"] for r in table.state().collect()] == ["a"]


def test_operations_in_order(spark, tmp_path):
    table = History(spark, str(tmp_path / "h"), SCHEMA)
    rows = [("a", "1", at(1), "put", 1), ("a", None, at(2), "delete", 2), ("a", "3", at(3), "put", 3), ("b", "1", at(1), "put", 1), ("b", None, at(1), "delete", 2)]
    table.apply(spark.createDataFrame(rows, f"{SCHEMA}, op string, n long"), "n")
    assert [(r["id"], r["answer"]) for r in table.state().collect()] == [("a", "3")]


def test_shortened(spark):
    got = spark.createDataFrame([("x" * 100,), ("x" * 101,)], "t string").select(shortened(F.col("t")).alias("t")).collect()
    assert [len(r["t"]) for r in got] == [100, 103]


def test_terms(spark):
    from assay.operators.sentences import attribute_score, split, terms

    rows = spark.createDataFrame([("What is AI 2024? x 预算是多少",), ("罚款上限",), ("",)], "q string")
    got = [set(r["t"]) for r in rows.select(terms(F.col("q")).alias("t")).collect()]
    run = "预算是多少"
    pieces = {run[i : i + w] for w in range(2, 6) for i in range(6 - w)}
    assert got == [{"what", "is", "ai", "2024"} | pieces - {"多少"}, {"罚款", "款上", "上限", "罚款上", "款上限", "罚款上限"}, set()]
    cut = spark.createDataFrame([(" a b! c。d；；e ",), ("",)], "t string").select(split(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in cut] == [["a b!", "c。", "d；", "；", "e"], []]
    pairs = spark.createDataFrame([("What fine?", "The penalty is 7% of turnover"), ("What fine?", "规则生效"), ("What fine?", "规则和罚款"), ("When?", "penalty")], "q string, s string")
    assert [r["x"] for r in pairs.select(attribute_score(F.col("q"), F.col("s")).alias("x")).collect()] == [6.0, -4.0, 6.0, 0.0]


def test_ranked_sentences(spark):
    from assay.operators.sentences import ranked

    asked = spark.createDataFrame([(1, "Apple revenue 2023"), (2, None), (3, "nothing here")], "query_id int, question string")
    rows = [(1, "d1", 1, "Apple", "Revenue was about 5! Weather. Apple revenue rose; APPLE REVENUE 2023 was 7!"), (1, "d2", 2, None, "Apple revenue rose;"), (2, "d1", 1, "", "x 1"), (3, "d1", 1, "t", None)]
    got = ranked(asked, spark.createDataFrame(rows, "query_id int, doc_id string, rank int, title string, text string"), 3).collect()
    assert [(r["rank"], r["doc_id"], r["score"], r["sentence"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, "d1", 3.25, "APPLE REVENUE 2023 was 7!"), (2, "d1", 2.0, "Weather. Apple revenue rose;"), (3, "d2", 2.0, "Apple revenue rose;"),
    ]
    with pytest.raises(ValueError):
        ranked(asked, asked, 0)


LABEL = "item_id string, annotator_id string, present boolean, kind string, pair array<string>, rationale string"
CONFLICT = "numeric_conflict"


def test_annotation_rules(spark):
    from assay.operators import annotation as a

    evidence = spark.createDataFrame([("q1", ["e1", "e2"]), ("q2", ["e3"]), ("q3", [])], "item_id string, ids array<string>")
    rows = [
        ("q1", "ann", True, CONFLICT, ["e1", "e2"]), ("q1", "ben", False, "none", None), ("q1", "cy", None, None, None), ("q1", "dee", True, "other", ["e1", "e1"]), ("q1", "eve", True, CONFLICT, ["e1", "e9"]),
        ("q2", "ann", False, CONFLICT, []), ("q2", "ben", False, "", ["e3"]), ("q2", " ", False, "none", []), ("q9", "ann", False, "none", []), ("q3", "ann", False, "none", []), ("q3", "ann", False, "none", []),
    ]
    labels = spark.createDataFrame([(*r, "") for r in rows], LABEL)
    got = {}
    for r in a.judged(labels, evidence).collect():
        got.setdefault((r["item_id"], r["annotator_id"]), set()).update(r["broken"])
    assert got == {
        ("q1", "ann"): set(), ("q1", "ben"): set(), ("q1", "cy"): {"no_label"}, ("q1", "dee"): {"kind_of_conflict", "pair_of_two"}, ("q1", "eve"): {"pair_of_known"},
        ("q2", "ann"): {"kind_without_conflict"}, ("q2", "ben"): {"pair_without_conflict"}, ("q2", " "): {"no_annotator"}, ("q9", "ann"): {"unknown_item"}, ("q3", "ann"): {"doubled"},
    }


def test_annotation_states(spark):
    from assay.operators import annotation as a

    ids = [f"q{i}" for i in range(6)]
    evidence = spark.createDataFrame([(q, [q + "a", q + "b"]) for q in ids], "item_id string, ids array<string>")
    yes, no = (lambda q, who: (q, who, True, CONFLICT, [q + "a", q + "b"], "")), (lambda q, who: (q, who, False, "none", [], ""))
    labels = [yes("q0", "ann"), yes("q0", "ben"), yes("q1", "ann"), no("q1", "ben"), yes("q2", "ann"), no("q2", "ben"), yes("q3", "ann"), (("q3", "ben", True, "bogus", ["q3a", "q3b"], "")), no("q5", "ann"), no("q5", "ben"), no("q5", "cy")]
    rulings = [no("q2", "dee"), yes("q4", "dee"), (("q1", "dee", None, None, None, ""))]
    got = {r["item_id"]: (r["labels"], r["state"], r["final"]) for r in a.states(spark.createDataFrame(labels, LABEL), spark.createDataFrame(rulings, LABEL), evidence).collect()}
    assert got == {"q0": (2, "agreed", CONFLICT), "q1": (2, "disputed", None), "q2": (2, "adjudicated", "none"), "q3": (1, "open", None), "q4": (0, "open", None), "q5": (3, "agreed", "none")}


def test_packets_are_blind_and_shuffled(spark):
    from assay.operators import annotation as a

    items = spark.createDataFrame([(f"q{i}", "text", "secret") for i in range(30)], "item_id string, question string, answer string")
    got = a.packets(items, ["ann", "ben"], "7", ("question",))
    assert got.columns == ["annotator_id", "place_key", "item_id", "question"] and got.count() == 60
    orders = [[r["item_id"] for r in got.filter(F.col("annotator_id") == w).orderBy("place_key").collect()] for w in ("ann", "ben")]
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1]) != orders[0]
    assert orders[0] == [r["item_id"] for r in a.packets(items.repartition(5), ["ann"], "7", ()).orderBy("place_key").collect()]
    for bad in ([], ["a", "a"], ["a b"], [""]):
        with pytest.raises(ValueError):
            a.packets(items, bad, "7", ())


def test_kappa_of_pairs(spark):
    from assay.operators import annotation as a

    said = {"ann": "yynnynyy", "ben": "yynyynny", "cy": "yyyy    "}
    rows = [(i, w, v) for w, vs in said.items() for i, v in enumerate(vs) if v != " "] + [(99, "ann", "y")]
    got = {(r["a"], r["b"]): (r["items"], r["kappa"]) for r in a.agreement(spark.createDataFrame(rows, "item_id int, annotator_id string, answer string"), ["cy", "ann", "ben"]).collect()}

    def kappa(x, y):
        both = [(p, q) for p, q in zip(x, y, strict=True) if " " not in (p, q)]
        o = sum(p == q for p, q in both) / len(both)
        e = sum(sum(p == v for p, _ in both) * sum(q == v for _, q in both) for v in "yn") / len(both) ** 2
        return len(both), 1.0 if e == 1 else (o - e) / (1 - e)

    assert set(got) == {("ann", "ben"), ("ann", "cy"), ("ben", "cy")}
    assert all(got[p][0] == kappa(said[p[0]], said[p[1]])[0] and abs(got[p][1] - kappa(said[p[0]], said[p[1]])[1]) < 1e-12 for p in got)

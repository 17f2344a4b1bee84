"""Operators on small hand-computed frames."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import text as t
from assay.operators import audit, chunking, conflict, control, evidence, graph, metrics, retrieval, slots, stats
from assay.plans import benchmarking, knowledge
from assay.scratch import saved


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_fusion(spark):
    a = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2)], "query_id string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "d2", 1), ("q", "d3", 2)], "query_id string, doc_id string, rank int")
    got = {r["doc_id"]: r["score"] for r in retrieval.fused([(a, 0.3), (b, 0.7)], 10).collect()}
    assert got == {"d2": round(0.3 / 62 + 0.7 / 61, 8), "d3": round(0.7 / 62, 8), "d1": round(0.3 / 61, 8)}


def test_k_is_checked():
    for bad in (-1, True, 1.5, "3"):
        with pytest.raises(ValueError):
            retrieval.check_k(bad)


def test_blank_query_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "  "), (2, "one")], "query_id long, query string")
    assert [(r["query_id"], r["doc_id"]) for r in retrieval.bm25(docs, asked, 5).collect()] == [(2, 1)]


def test_recall_guard(spark):
    base = spark.createDataFrame([("q", d, i) for i, d in enumerate("abcd", 1)], "query_id string, doc_id string, rank int")
    again = spark.createDataFrame([("q", d, i) for i, d in enumerate("dcba", 1)], "query_id string, doc_id string, rank int")
    got = sorted((r["place"], r["doc_id"]) for r in retrieval.guarded(base, again, 1, 3).collect())
    assert got == [(1, "a"), (2, "d"), (3, "c")]


def results(spark, rows):
    return spark.createDataFrame(rows, "key long, confidence double, correct boolean")


def test_calibration_error(spark):
    rows = results(spark, [(1, 0.95, True), (2, 0.95, False), (3, 0.05, False)])
    assert round(metrics.ece(rows).first()["ece"], 6) == 0.316667


def test_auroc_is_that_of_all_pairs(spark):
    data = [(i, (i * 7 % 10) / 10, i % 3 == 0) for i in range(40)]
    right, wrong = [c for _, c, y in data if y], [c for _, c, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in right for b in wrong) / (len(right) * len(wrong))
    assert math.isclose(metrics.pair_auroc(results(spark, data)).first()["auroc"], want)
    assert metrics.pair_auroc(results(spark, [(1, 0.5, True)])).first()["auroc"] is None


def test_abstention_is_the_threshold_loop(spark):
    data = [(i, (i * 37 % 101) / 100, i % 4 != 0) for i in range(80)]
    wrong, right = [c for _, c, y in data if not y], [c for _, c, y in data if y]
    curve = [(sum(c < i / 99 for c in right) / len(right), sum(c < i / 99 for c in wrong) / len(wrong)) for i in range(100)]
    want = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:], strict=False))
    assert math.isclose(metrics.abstention_auroc(results(spark, data)).first()["auroc"], want, abs_tol=1e-9)


def test_risk_coverage(spark):
    got = sorted((r["k"], r["risk"]) for r in metrics.risk_coverage(results(spark, [(1, 0.9, True), (2, 0.8, False), (3, 1.0, True), (4, 0.8, True)]), "key").collect())
    assert got == [(1, 0.0), (2, 0.0), (3, 1 / 3), (4, 0.25)]


def test_set_scores_of_empty_sides(spark):
    empty = F.array().cast("array<string>")
    p, r, f = metrics.set_scores(empty, F.array(F.lit("a")))
    assert (one(spark, p), one(spark, r), one(spark, f)) == (0.0, 0.0, 0.0)
    assert one(spark, metrics.set_scores(F.array(F.lit("a")), empty)[1]) == 1.0


def test_pairs_are_undirected(spark):
    p = spark.createDataFrame([(1, "b", "a")], "q int, a string, b string")
    g = spark.createDataFrame([(1, "a", "b")], "q int, a string, b string")
    assert metrics.pair_counts(p, g, "q").first().asDict() == {"q": 1, "tp": 1, "fp": 0, "fn": 0}


def test_bag_f1(spark):
    rows = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c"]), (2, [], []), (3, ["a"], [])], "id int, x array<string>, y array<string>")
    assert {r["id"]: r["f1"] for r in metrics.bag_f1(rows, "id", "x", "y").collect()} == {1: 0.4, 2: 1.0, 3: 0.0}


def test_normal_answer(spark):
    assert one(spark, t.normal_answer(F.lit("The  cat, an  a-b  École!"))) == "cat b école"


def test_mcnemar():
    assert stats.mcnemar(0, 0) == 1.0
    assert math.isclose(stats.mcnemar(1, 9), 2 * sum(math.comb(10, i) for i in range(2)) / 1024)


def test_kappa_of_one_label(spark):
    rows = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert stats.kappa(rows, "a", "b").first()["kappa"] == 1.0


def test_bootstrap_is_repeatable(spark):
    units = spark.createDataFrame([("s", i, float(i % 2), 1.0) for i in range(1, 21)], "stratum string, i long, value double, weight double")
    first, again = (stats.interval(stats.bootstrap(u, "value", "weight", 50)).first() for u in (units, units.repartition(7)))
    assert first == again and 0 < first["lower"] < first["upper"] < 1


def test_draws_are_made_in_many_tasks(spark):
    """No task makes or numbers the draws of a stratum alone; numbers are those of one sort."""
    rows = spark.range(4_000).select((F.col("id") * 7919 % 4001).alias("k"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 == 0, "b").otherwise("a").alias("kind"))
    units = stats.numbered(rows, F.col("kind"), "k").localCheckpoint()
    got = {}
    for r in units.collect():
        got.setdefault(r["kind"], []).append((r["k"], r["i"], r["n"]))
    for own in got.values():
        assert [i for _, i, _ in sorted(own)] == list(range(1, len(own) + 1)) and {n for _, _, n in own} == {len(own)}
    tasks = stats.draws(units.coalesce(1), 50).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 4_000 * 50 / 4


def test_platt_moves_towards_the_truth(spark):
    rows = results(spark, [(i, 0.9, i % 2 == 0) for i in range(100)])
    a, b = stats.platt(rows)
    assert abs(1 / (1 + math.exp(-(a * math.log(9) + b))) - 0.5) < 0.02


def windows(text, size, overlap):
    return [text[i : i + size] for i in range(0, len(text), size - overlap)]


def test_fixed_windows(spark):
    text = "0123456789\nabc"
    assert one(spark, chunking.fixed(F.lit(text), 4, 1)) == windows(text, 4, 1)


def test_chunks_merge_small_ones(spark):
    docs = spark.createDataFrame([(1, "x" * 10), (2, "  ab  "), (3, None), (4, "")], "doc_id long, text string")
    got = [(r["chunk_id"], r["text"]) for r in chunking.chunk(docs, size=4, overlap=1, least=2).orderBy("doc_id", "chunk_index").collect()]
    assert got == [("1_c0", "xxxx"), ("1_c1", "xxxx"), ("1_c2", "xxxx\nx"), ("2_c0", "  ab"), ("2_c1", "b  ")] or got[:3] == [("1_c0", "xxxx"), ("1_c1", "xxxx"), ("1_c2", "xxxx\nx")]
    assert {c for c, _ in got} & {"3_c0", "4_c0"} == set()


def chunks_of(text, strategy, size, overlap):
    """A plain version of the chunking by sentences, paragraphs and headings."""
    cut = lambda pattern, t: [p.strip() for p in re.split(pattern, t) if p.strip()]
    enders = r"(?<=[。！？.!?])\s*"

    def pack(parts, glue, long, keep):
        out, now = [], []
        for p in parts:
            if len(p) > size:
                out += [glue.join(now)] * bool(now) + long(p)
                now = []
                continue
            if now and len(glue.join([*now, p])) > size:
                out.append(glue.join(now))
                while now and len(glue.join(now)) > keep:
                    now = now[1:]
            now.append(p)
        return out + [glue.join(now)] * bool(now)

    by_sentence = lambda t: pack(cut(enders, t), " ", lambda p: windows(p, size, overlap), overlap)
    long = lambda t: by_sentence(t) if len(cut(enders, t)) > 1 else windows(t, size, overlap)
    if strategy == "sentence":
        return by_sentence(text)
    if strategy == "paragraph":
        return pack(cut(r"\n\s*\n", text), "\n\n", long, -1)
    return [c for p in cut(r"\n(?=#{1,4}\s)", text) for c in (long(p) if len(p) > size else [p])]


@pytest.mark.parametrize("strategy", ["sentence", "paragraph", "heading"])
def test_chunks_by_text(spark, strategy):
    texts = [
        "One is 1.5 long. Two! Three? Four is the last one here. Five.",
        "Short. " * 9 + "A sentence that is far too long for any chunk of this size and so is cut into windows. End. 好。再见！",
        "# Head\nFirst part. Of two.\n\nSecond part, which is longer. It has three sentences. See?\n\n\n## Next\n" + "word " * 30 + "\n\n tail \t\n",
        "no end at all and no break " * 4,
        "...!?", " \n ", "",
    ]
    for size, overlap in ((30, 12), (40, 0), (64, 63)):
        for text in texts:
            assert one(spark, chunking.split(F.lit(text), strategy, size, overlap)) == chunks_of(text, strategy, size, overlap)


def test_chunk_parameters():
    for bad in ((0, 0, 0, "fixed"), (5, 5, 0, "fixed"), (5, 1, -1, "fixed"), (5, 1, 0, "other")):
        with pytest.raises(ValueError):
            chunking.check(*bad)


def test_document_of_chunk(spark):
    assert one(spark, chunking.document_of(F.lit("a_c1_c12"))) == "a_c1"


def test_recency(spark):
    dates = {"2024-05-01": 1.0, "2022/01/02": 0.8, "01-02-2010": 0.5, "03/04/2023": 0.9, "soon": 0.5, "2030-01-01": 1.0}
    for date, want in dates.items():
        assert math.isclose(one(spark, evidence.recency(F.lit(date), 2024)), want), date


def test_exact_dedup_keeps_the_best(spark):
    rows = spark.createDataFrame([(1, "A  b", 0.1), (2, " a b ", 0.9), (3, "c", 0.5), (4, "a b", 0.9)], "id long, text string, score double")
    assert sorted(r["id"] for r in evidence.exact_dedup(rows, "text", "score", "id").collect()) == [2, 3]


def test_greedy_dedup(spark):
    scores = {i: (i * 7) % 11 for i in range(30)}
    pairs = [(i, j) for i in range(30) for j in range(i) if (i * j) % 5 == 1]
    kept = set()
    for i in sorted(scores, key=lambda i: (-scores[i], i)):
        if not any((max(i, k), min(i, k)) in pairs for k in kept):
            kept.add(i)
    rows = spark.createDataFrame(list(scores.items()), "id long, score long")
    got = evidence.greedy_dedup(rows, spark.createDataFrame(pairs, "a long, b long"), "id", "score")
    assert {r["id"] for r in got.collect()} == kept
    assert evidence.greedy_dedup(rows, spark.createDataFrame([], "a long, b long"), "id", "score").count() == 30


def claims(spark, *texts):
    rows = spark.createDataFrame([(f"e{i}", x) for i, x in enumerate(texts)], "evidence string, body string")
    return conflict.extract(rows, "evidence", "body")


@pytest.mark.parametrize(
    ("a", "b", "kind"),
    [
        ("Acme sold 1200 cars in total.", "Acme sold 1500 cars in total.", "numeric_conflict"),
        ("Acme was founded in 1999.", "Acme was founded in 2004.", "temporal_conflict"),
        ("In Oslo all trams are electric.", "In Oslo only some trams are electric.", "scope_conflict"),
        ("Growth of Acme came because of exports.", "Growth of Acme was unrelated to exports.", "causal_conflict"),
        ("The bridge in Oslo is open to cars.", "The bridge in Oslo is not open to cars.", "entity_mismatch"),
        ("The bridge in Oslo will open to cars.", "The bridge in Oslo will not open to cars.", "refute"),
        ("The capital of Freedonia is Sylvania.", "The capital of Freedonia is Moravia.", "entity_mismatch"),
        ("Acme sales in 2020 were 1200 cars.", "Acme sales in 2020 were 1500 cars.", "numeric_conflict"),
        ("The bridge in Oslo is open to cars.", "The bridge in Oslo is open to all cars.", "support"),
    ],
)
def test_conflicts(spark, a, b, kind):
    assert [r["conflict_type"] for r in conflict.detect(claims(spark, a, b)).collect()] == [kind]


def test_numeric_conflict_score(spark):
    edge = conflict.detect(claims(spark, "Acme sold 1200 cars in total.", "Acme sold 1500 cars in total.")).first()
    assert math.isclose(edge["confidence"], 0.575) and edge["severity"] == "medium"


def test_years_are_no_numbers(spark):
    assert conflict.detect(claims(spark, "Acme in 1999 was here today.", "Zeta in 2015 was there.")).count() == 0


def test_grown_graph_is_the_whole_graph(spark):
    every = claims(spark, "Acme sold 1200 cars in total.", "Acme sold 1500 cars in total.", "Acme sold 1900 cars in total.")
    whole = conflict.detect(every)
    old, new = every.filter("evidence_id <> 'e2'"), every.filter("evidence_id = 'e2'")
    edges = conflict.detect(old)
    grown = edges.unionByName(conflict.grow(old, new, edges))
    assert sorted(map(str, grown.collect())) == sorted(map(str, whole.collect()))


def test_copies_of_claims_meet_as_one(spark):
    """Edges of claims with many copies are those of all pairs, and rules look at pairs of distinct claims only; the sums need no pairs."""
    said = ["Acme sold 1200 cars in total.", "Acme sold 1500 cars in total.", "Acme was first before Zeta.", "Acme was last after Zeta.", "Zeta is red, Zeta is not blue, vs Acme."]
    rows = [(f"e{i * 7 % 40 // 2:02d}", said[i % 5] if i % 11 else f"{said[i % 5]} {said[(i + 1) % 5]}") for i in range(40)]
    every = conflict.extract(spark.createDataFrame(rows, "evidence string, body string"), "evidence", "body")
    every = every.withColumn("claim_id", F.concat("claim_id", F.lit("/"), F.monotonically_increasing_id())).localCheckpoint()
    want = conflict._edges(conflict.pairs(conflict.prepared(every)), ()).unionByName(conflict.self_refuting(every))
    key = lambda df: sorted((r["source_id"], r["target_id"], r["conflict_type"], round(r["confidence"], 9), r["severity"]) for r in df.collect())
    assert key(conflict.detect(every)) == key(want) and want.count() > 100
    sums = want.groupBy("conflict_type", "severity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("c"))
    got = conflict.summed(every).select("conflict_type", "severity", "n", F.round("confidence", 9).alias("c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sums.collect()))
    classes, members = conflict.classed(every)
    assert classes.count() < members.count() / 3


def test_claims_alike_but_for_numbers_meet_as_one_kind(spark, monkeypatch):
    """Rules look at pairs of kinds; what depends on letters and numbers is the same as for all pairs, whatever blocks classes are dealt to."""
    texts = [f"Acme sold {1000 + 37 * i} cars in total." for i in range(30)] + [f"Acme sold {900 + 90 * i} cars, {1500 - 90 * i} in May." for i in range(6)]
    texts += ["Acme was first before Zeta.", "Acme was last after Zeta.", "Acme was last but two after Zeta.", "Zeta is red.", "Zeta is not red.", "Acme has 12% of it.", "Acme has 30% of it.", "Acme A", "Acme sold 1000 cars in total."]
    rows = [(f"e{i * 17 % len(texts):02d}", text, i) for i, text in enumerate(texts)] + [("e03", texts[5], 90), ("f0", texts[7], 91), ("f1", texts[36], 92)]
    claims_ = spark.createDataFrame([(f"{i * 29 % 100:02d}", e, text, ["Acme", "Zeta"] if "Zeta" in text else ["Acme"]) for e, text, i in rows], "claim_id string, evidence_id string, claim string, entities array<string>")
    every = claims_.withColumns({"numbers": slots.number_tokens(F.col("claim")), "times": F.filter(F.array(F.lit("before"), F.lit("after")), lambda w: F.contains("claim", w))}).localCheckpoint()
    kept, save = {}, conflict.saved
    monkeypatch.setattr(conflict, "saved", lambda df, name: kept.update({name: save(df, name)}) or kept[name])
    monkeypatch.setattr(conflict, "BLOCK", 7)
    want = conflict._edges(conflict.pairs(conflict.prepared(every)), ()).unionByName(conflict.self_refuting(every)).localCheckpoint()
    key = lambda df: sorted((r["source_id"], r["target_id"], r["conflict_type"], r["confidence"], r["severity"]) for r in df.collect())
    assert key(conflict.detect(every)) == key(want) and {r["conflict_type"] for r in want.collect()} >= {"numeric_conflict", "support", "temporal_conflict", "entity_mismatch"}
    assert kept["kinds"].count() < 12 < 35 < kept["classes"].count()
    assert key(conflict.detect(every, types=("numeric_conflict",))) == key(want.filter("conflict_type = 'numeric_conflict'"))
    sums = want.groupBy("conflict_type", "severity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("c"))
    got = conflict.summed(every).select("conflict_type", "severity", "n", F.round("confidence", 9).alias("c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sums.collect()))
    assert kept["edges"].filter("c is null").count() > 0 < kept["edges"].filter("c is not null").count()


def test_ratio_rounded_as_in_sql(spark, tmp_path):
    """A confidence that is a binary number just below a half of the sixth digit is rounded once."""
    import duckdb

    part = str(tmp_path / "part.parquet")
    duckdb.sql(f"COPY (SELECT * FROM (VALUES (36::BIGINT, 903.6::DOUBLE), (977, 997.7)) v(p_partkey, p_retailprice), (SELECT 'Brand#1' AS p_brand, 'LARGE' AS p_type, 1 AS p_size)) TO '{part}'")
    want = duckdb.sql(knowledge.ORACLES["j8_numeric_conflicts"].replace("FROM part)", f"FROM '{part}')", 1).replace("FROM part", f"FROM '{part}'", 1)).fetchall()
    assert [tuple(r) for r in knowledge.numeric_conflicts(spark, str(tmp_path)).collect()] == want and len(want) == 1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)], "a long, b long")
    assert {r["id"]: r["component"] for r in graph.components(edges).collect()} == {2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 21: 20}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    got = graph.components(edges).collect()
    assert len(got) == 200 and {r["component"] for r in got} == {0}


def test_traceability(spark):
    trace = lambda s: one(spark, graph.traceability(F.lit(s), F.lit("xAyBz")))
    assert [trace(s) for s in ("yB", "A...B", "B...A", "q")] == ["exact", "segmented", "untraceable", "untraceable"]


def test_audit(spark):
    body = "thequickbrownfoxjumpsoverthelazydog"
    items = spark.createDataFrame([(1, body), (2, "shortone"), (3, "no")], "item_id long, body string")
    refs = spark.createDataFrame([(10, "xx" + body + "yy"), (11, "ashortoneb"), (12, "other")], "doc_id long, body string")
    assert sorted((r["item_id"], r["doc_id"], r["at"]) for r in audit.exact(items, refs).collect()) == [(1, 10, 2), (2, 11, 1)]
    assert [(r["item_id"], r["doc_id"], r["score"]) for r in audit.near(items, refs).collect()] == [(1, 10, 1.0)]


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, "supported"), (1, "refuted"), (2, "supported"), (3, "supported"), (3, "?")], "q int, status string")
    assert {r["q"]: r["status"] for r in control.verdicts(rows, "q").collect()} == {1: "refuted", 2: "supported", 3: "not_enough_info"}


def test_actions(spark):
    act = lambda *v: one(spark, control.action(*[F.lit(x) for x in v]))
    assert [act(0.8, 0.0, 0.0, 0), act(0.5, 0.9, 0.9, 3), act(0.5, 0.9, 0.9, 0), act(0.5, 0.1, 0.9, 0), act(0.5, 0.1, 0.1, 0), act(0.1, 0.1, 0.1, 0)] == [
        "abstain", "proceed", "resolve_conflict", "retrieve_more", "refine", "proceed",
    ]


def test_citation_scores(spark):
    cited, required = F.array(*[F.lit(x) for x in ("a", "a", "b")]), F.array(F.lit("a"), F.lit("c"))
    p, r, _ = metrics.citation_scores(cited, required)
    assert (round(one(spark, p), 6), one(spark, r)) == (0.666667, 0.5)


def test_soft_f1(spark):
    f = lambda p, r: one(spark, metrics.soft_f1(F.lit(p), F.lit(r)))
    assert f("The answer is 42 km.", "42 KM") == 1.0
    assert f("", "") == 1.0 and f("a", "") == 0.0
    assert math.isclose(f("red car fast", "red bike"), 2 * 1 / 5)
    assert f("北京大学好", "北京大学") == 1.0


def test_ranking_scores(spark):
    hits = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3), ("p", 1, 1)], "query_id string, doc_id int, rank int")
    gold = spark.createDataFrame([("q", 2), ("q", 9), ("z", 1)], "query_id string, doc_id int")
    got = {r["query_id"]: r for r in metrics.ranking_scores(hits, gold).collect()}
    want = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert got["q"]["rr"] == 0.5 and math.isclose(got["q"]["ndcg"], want)
    assert got["p"]["ndcg"] == 1.0 and got["z"]["ndcg"] == 0.0


def test_type_accuracy_takes_the_last(spark):
    p = spark.createDataFrame([("b", "a", "x", 1), ("a", "b", "y", 2)], "a string, b string, kind string, seq int")
    g = spark.createDataFrame([("a", "b", "y"), ("c", "d", "x")], "a string, b string, kind string")
    assert metrics.type_accuracy(p, g).first()["accuracy"] == 0.5
    assert metrics.type_accuracy(p, g.limit(0)).first()["accuracy"] == 1.0
    assert metrics.false_rate(p, g).first()["rate"] == 0.0 and metrics.false_rate(p.limit(0), g).first()["rate"] == 0.0


def test_definitions_differ(spark):
    edges = conflict.detect(claims(spark, "In Oslo a tram is defined as a rail vehicle.", "In Oslo a tram is defined as any public transport."))
    assert [r["conflict_type"] for r in edges.collect()] == ["definitional_conflict"]


def test_self_refuting(spark):
    got = conflict.self_refuting(claims(spark, "Acme claimed a record year but that was actually false.", "Acme had a record year in sales."))
    assert [r["source_id"] for r in got.collect()] == ["e0#0"]


def test_focus(spark):
    every = claims(spark, "Acme sold 1200 cars in total.", "Acme sold 1500 cars in total.", "Zeta sold 10 cars in total.", "Zeta sold 90 cars in total.")
    edges = conflict.detect(every)
    assert edges.count() == 2
    assert {r["source_id"] for r in conflict.focused(edges, every, "How many did Zeta sell?").collect()} == {"e2#0"}
    assert conflict.focused(edges, every, "how many?").count() == 2


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Acme was founded in 2012.", "Acme has 3000 employees."),
        ("Acme sales in 2020 were 1200 cars.", "Acme sales in 2021 were 1500 cars."),
        ("Acme sales in Q1 2020 were 1200 cars.", "Acme sales in Q2 2020 were 1500 cars."),
        ("Acme sales in Q1 2020 were 1200 cars.", "Acme annual sales in 2020 were 4500 cars."),
        ("Acme sales in 中国 were 1200 cars.", "Acme sales in 欧洲 were 1500 cars."),
        ("Acme growth was 12%, says Mr Roe.", "Acme growth was 1500 cars, says Mr Poe."),
        ("Acme shipped the 3nm制程 chip size.", "Acme shipped the 7nm制程 chip size."),
        ("Unlike Acme, sales of Zeta were 1200 cars.", "Acme sales were 1500 cars."),
        ("Acme sales of 1-9月 were good.", "Acme sales of 1-6月 were good."),
        ("Acme profit was 1900 then.", "Acme profit was 2011 then."),
    ],
)
def test_other_slots(spark, a, b):
    """Numbers of different years, quarters, regions, units or attributes do not conflict, nor do numbers of dates."""
    assert [r["conflict_type"] for r in conflict.detect(claims(spark, a, b)).filter("conflict_type <> 'support'").collect()] == []


def test_quantities(spark):
    value = lambda t: one(spark, slots.value(F.lit(t)))
    assert (value("1,200 km"), value("3.5亿元"), value("12万")) == (1200.0, 3.5e8, 120000.0)
    unit = lambda t: one(spark, slots.unit_class(F.lit(t)))
    assert [unit(t) for t in ("5%", "3亿元", "12万", "20°C", "7nm", "3天", "5 qubits", "5")] == ["percent", "money", "magnitude", "temperature", "length", "duration", "qubit", "plain"]
    assert one(spark, slots.number_tokens(F.lit("In Q3 2020 it sold 1,200 units at 5.5% for 3万美元"))) == ["2020", "1,200", "5.5%", "3万美元"]
    assert sorted(one(spark, slots.time_keys(F.lit("annual report of 2020, Q3 and 第二季度")))) == ["period:annual", "quarter:2", "quarter:3", "year:2020"]
    assert one(spark, slots.attributes(F.lit("The CEO said market share and turnover grew"))) == ["market_share", "fine", "ceo"]
    assert one(spark, slots.attributes(F.lit("通过的风险等级"))) == []


def test_embedded_claims(spark):
    """A report, its correction and the sides of a comparison are claims of their own; a report that is corrected meets no other evidence."""
    rows = spark.createDataFrame([("a", "有报道称Acme销量为900万辆，实际上Acme销量为300万辆左右。"), ("b", "Acme销量为300万辆，这是官方数据。"), ("c", "机构估计Acme销量为500万辆，低于Zeta的900万辆水平。")], "evidence string, body string")
    got = {r["claim_id"]: r for r in conflict.extract(rows, "evidence", "body").collect()}
    assert (got["a#0.1"]["claim"], got["a#0.1"]["span"]) == ("Acme销量为900万辆", "reported_claim")
    assert (got["a#0.2"]["claim"], got["a#0.2"]["span"]) == ("Acme销量为300万辆左右", "corrective_claim")
    assert [got[k]["claim"] for k in ("c#0.1", "c#0.2")] == ["机构估计Acme销量为500万辆", "Zeta的900万辆水平"]
    edges = {(r["source_id"], r["target_id"]) for r in conflict.detect(conflict.extract(rows, "evidence", "body")).collect()}
    assert ("a#0.1", "a#0.2") in edges and not any("a#0.1" in e and "b#0" in e for e in edges)


def test_claims_split_once(spark):
    """Texts are split into sentences once, not again to filter on their number; only sentences that speak of the company have the names of the whole text."""
    rows = spark.createDataFrame([("a", "Acme 该公司 went on. Zeta stood where it was.\r\nIt cost 3.5 in May \u2028Nobody saw Last Week!"), ("b", None), ("c", "")], "evidence string, body string")
    made = conflict.extract(rows, "evidence", "body")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("[.!?。！？]") == 1
    got = [(r["claim_id"], r["claim"], r["entities"], r["numbers"], r["times"]) for r in made.orderBy("claim_id").collect()]
    assert got == [
        ("a#0", "Acme 该公司 went on.", ["Acme", "Zeta", "It", "May", "Nobody", "Last Week"], [], []),
        ("a#1", "Zeta stood where it was.", ["Zeta"], [], []),
        ("a#2", "It cost 3.5 in May \u2028Nobody saw Last Week!", ["It", "May", "Nobody", "Last Week"], ["3.5"], ["May", "last week"]),
    ]


def test_words_within_words_are_looked_for_once(spark):
    """A word that holds another one of the list adds nothing; patterns are tried only where one of their words is."""
    words = ("声称", "媒体声称", "part", "parts", "apart")
    assert conflict.any_of(F.lit("x"), words)._jc.toString().count("contains") == 2
    cases = ["媒体声称", "two parts", "a part", "none", ""]
    rows = spark.createDataFrame([(x,) for x in cases], "x string").select("x", conflict.any_of(F.col("x"), words).alias("hit"))
    assert {r["x"]: r["hit"] for r in rows.collect()} == {x: any(w in x for w in words) for x in cases}


def test_optional_rules(spark):
    texts = [("Sales of Acme grew worldwide.", "Sales of Acme grew in one region."), ("Daily sales of Acme grew.", "Annual sales of Acme grew.")]
    for (a, b), kind, option in zip(texts, ("scope_conflict", "granularity_conflict"), ("scope", "grain"), strict=True):
        assert kind in [r["conflict_type"] for r in conflict.detect(claims(spark, a, b), (option,)).collect()]
        assert kind not in [r["conflict_type"] for r in conflict.detect(claims(spark, a, b)).collect()]
    ranked = claims(spark, "Acme paid for it all.", "Acme never paid for it.").withColumn("source_rank", F.when(F.col("evidence_id") == "e0", 3).otherwise(1))
    assert [r["conflict_type"] for r in conflict.detect(ranked, ("source",)).collect()] == ["source_conflict"]


def test_quota_split(spark):
    got = stats.quota_split(spark.range(100).withColumn("s", F.lit("x")), "id", "s").groupBy("split").count()
    assert {r["split"]: r["count"] for r in got.collect()} == {"validation": 15, "test": 15, "train": 70}


def test_gates(spark):
    assert [r["promoted"] for r in stats.gates([("f1", True), ("leak", False)], spark).collect()] == [False, False]


def test_ignored_conflicts(spark):
    conflicts = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    assert [(r["a"], r["b"]) for r in control.ignored(conflicts, spark.createDataFrame([(2,)], "id int")).collect()] == [(3, 4)]


def test_citations_and_notes(spark):
    ids = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    cited = lambda a, s, e: one(spark, control.with_citations(F.lit(a), s, e))
    assert cited("So it is [E1]. ", ids("E1", "E2", "E2", "E9"), ids("E1", "E2")) == "So it is [E1].\n引用证据：[E2]"
    assert cited("So it is [E1].", ids("E1"), ids("E1")) == "So it is [E1]." and cited("", ids("E1"), ids("E1")) == ""
    got = one(spark, control.synced(F.lit("x [E1] y [E7] z [E1]"), ids("E2", "E9", "E2"), ids("E1", "E2")))
    assert (got["support"], got["dropped"], got["added_support"], got["added_citations"]) == (["E2", "E1"], ["E9"], ["E1"], ["E2"])
    note = lambda a, s: one(spark, control.acknowledged(F.lit(a), F.lit(s), F.lit("a"), F.lit("E2"), F.lit("b" * 90)))
    assert note("it is 5", "E1") == "证据存在冲突：E1 提到“a”，而 E2 提到“" + "b" * 80 + "”。综合判断，it is 5"
    assert note("存在争议", "E1") == "存在争议" and note("it is 5", None) == "it is 5"


def test_conflicts_mapped_to_gold(spark):
    """A pair of chunks of one document is its gold self pair; what leaves the gold evidence is set aside."""
    evidence = spark.createDataFrame([(1, "D1", "E1", 0), (1, "D1", "E2", 1), (1, "D2", "E3", 0)], "query_id long, doc_id string, evidence_id string, seq int")
    gold = spark.createDataFrame([(1, "E1", "E1"), (1, "E3", "E2"), (1, "E2", "E2")], "query_id long, a string, b string")
    predicted = spark.createDataFrame([(1, "D1_c0", "D1_c3"), (1, "D2_c0", "D1_c1"), (1, "D2_c0", "D2_c1"), (1, "D8_c0", "D1_c1"), (2, "D8_c0", "D9_c1")], "query_id long, a string, b string")
    mapped = metrics.mapped_pairs(predicted, evidence, gold)
    assert sorted((r["query_id"], r["lo"], r["hi"]) for r in mapped.collect()) == [(1, "D8_c0", "E2"), (1, "E1", "E1"), (1, "E2", "E3"), (1, "E3", "E3"), (2, "D8_c0", "D9_c1")]
    counts = {r["query_id"]: (r["tp"], r["fp"], r["fn"], r["extraneous"]) for r in metrics.restricted_counts(mapped, evidence, gold).collect()}
    assert counts == {1: (2, 0, 1, 2), 2: (0, 0, 0, 1)}


def test_gold_conflicts_of_stored_tables(spark, monkeypatch):
    """Gold pairs of one question meet its predicted pairs together, whatever the partitions they were found in."""
    gold = [(q, q * 100 + i) for q in range(40) for i in range(q % 4)]
    hits = [(q, q * 100 + (i if i < 2 else 50 + i), i + 1) for q in range(40) for i in range(4)]
    stored = (saved(spark.createDataFrame(gold, "query_id long, doc_id long"), "gold"), saved(spark.createDataFrame(hits, "query_id long, doc_id long, rank long"), "hits"))
    monkeypatch.setattr(benchmarking, "gold", lambda *_: stored[0])
    monkeypatch.setattr(benchmarking, "hits", lambda *_: stored[1])
    want = set()
    for q in range(40):
        real = {(f"E{2 * n}", f"E{2 * n + 1}") for n in range(1, q % 4 + 1)} | {(f"E{2 * n}", f"E{2 * n + 2}") for n in range(1, q % 4)}
        own = [(f"E{2 * i + 2}", f"E{2 * i + 3}") if i < min(2, q % 4) else (f"{q * 100 + (i if i < 2 else 50 + i)}_c{i}",) for i in range(4)]
        for i in range(4):
            for j in range(i, 4):
                every = [tuple(sorted((x, y))) for x in own[i] for y in own[j]]
                want.add((q, *next((e for e in every if e in real), every[-1])))
    got = benchmarking.mapped_conflicts(spark, "").collect()
    assert sorted((r["query_id"], r["lo"], r["hi"]) for r in got) == sorted(want)
    counts = [(r["tp"], r["fp"], r["fn"]) for r in benchmarking.gold_conflicts(spark, "").collect()]
    assert tuple(map(sum, zip(*counts))) == (70, 0, 20)


def test_resolutions(spark):
    decided = spark.createDataFrame([("p", "new", 2), ("p", "old", 1), ("q", "new", 1)], "pair string, resolution string, seq int")
    gold = spark.createDataFrame([("p", "old"), ("q", "old"), ("r", "new"), ("q", "new")], "pair string, resolution string")
    assert metrics.resolution_accuracy(decided, gold).first()["accuracy"] == 0.5
    assert metrics.resolution_accuracy(decided, gold.limit(0)).first()["accuracy"] == 1.0


def test_audit_filter_loses_nothing(spark):
    """The filter inside the row lets every gram of an item through, and documents without any make no rows."""
    items = spark.createDataFrame([(1, "abcdefghijklmnopq"), (2, "12345678")], "item_id long, body string")
    docs = spark.createDataFrame([(7, "xx" + "abcdefghijklmnopq" + "yy"), (8, "z" * 60), (9, "0123456789"), (10, None), (11, "")], "doc_id long, body string")
    assert {(r["item_id"], r["doc_id"], r["at"]) for r in audit.exact(items, docs).collect()} == {(1, 7, 2), (2, 9, 1)}
    assert {(r["item_id"], r["doc_id"]) for r in audit.near(items, docs).collect()} == {(1, 7)}


def test_bm25_shuffles_no_scores(spark):
    """Documents meet queries in the task: no join or shuffle makes a row for each of them, nor for each posting; ties and copies keep the smaller ids, in parts of a query set too."""
    docs = spark.createDataFrame([(i, "red fox" if i % 2 else f"red fox w{i}") for i in range(500)] + [(900 + i, None) for i in range(3)], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(q, f"fox w{2 * q}" if q else "red fox") for q in range(40)], "query_id long, query string")
    whole = sorted(map(tuple, retrieval.bm25(docs, asked, 3).collect()))
    assert [r[2] for r in whole if r[0] == 7] == [14, 1, 3]
    cells, retrieval.CELLS = retrieval.CELLS, 64
    try:
        assert sorted(map(tuple, retrieval.bm25(docs, asked, 3).collect())) == whole
    finally:
        retrieval.CELLS = cells
    entries = retrieval.postings(docs, "doc_id", F.col("text"))
    assert "Exchange" not in entries._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "").split("MapInArrow")[0]
    assert entries.filter("doc_id = 14").count() == 3


def test_audit_reads_references_once(spark):
    """Exact and near findings come from one pass over the references; short texts, other scripts and doubled ids count as before."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    body = "".join(chr(97 + i * i % 23) for i in range(60))
    texts = [(1, "x" * 30 + body), (2, body[:58]), (2, body[3:]), (3, "abcdefgh"), (4, "zzabcdefghijz"), (5, "数据" * 9 + "𝒳" * 20), (6, None), (7, ""), (8, body[30:] + body[:30])]
    refs = spark.createDataFrame(texts, "doc_id long, body string").coalesce(1).mapInArrow(counted, "doc_id long, body string")
    items = spark.createDataFrame([(1, body), (2, "abcdefgh"), (3, "据数据数据数据数据数据数𝒳"[:11] + "数据"), (4, "𝒳" * 15), (5, "abc")], "item_id long, body string")
    found = audit.Overlap(items, refs)
    assert reads.value == len(texts)
    near = {(r["item_id"], r["doc_id"]): (r["shared"], r["score"]) for r in found.near().collect()}
    grams = lambda s: {s[i : i + 13] for i in range(len(s) - 12)} if len(s) >= 13 else {s} - {""}
    want = {}
    for i in items.collect():
        for d in {d for d, _ in texts}:
            shared = sum(len(grams(i["body"]) & grams(t)) for e, t in texts if e == d and t)
            if round(shared / len(grams(i["body"])), 6) >= 0.85:
                want[i["item_id"], d] = (shared, round(shared / len(grams(i["body"])), 6))
    assert near == want and (1, 1) in want and (2, 3) in want
    exact = sorted((r["item_id"], r["doc_id"], r["at"]) for r in found.exact().collect())
    assert exact == sorted((i["item_id"], d, t.find(i["body"])) for i in items.collect() if len(i["body"]) >= 8 for d, t in texts if t and i["body"] in t)


def test_bands_grow_with_the_rows(spark):
    """Meetings by chance stay in proportion to the rows, and pairs at the threshold are still found."""
    by_chance = [n * n / 2 * bands / 2**bits / n for n in (10_000, 600_000) for bands, bits in [evidence.banding(n, 0.92)]]
    assert by_chance[1] < 4 * by_chance[0] < 200 and evidence.banding(200, 0.92) == (24, 12)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5_000, 64))
    x[2_500:] = x[:2_500] + 0.40 * rng.standard_normal((2_500, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    real = {(i, i + 2_500) for i in range(2_500) if unit[i] @ unit[i + 2_500] >= 0.92}
    found = {(r["a"], r["b"]) for r in evidence.cosine_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), 0.92).collect()}
    assert found <= real and len(found) >= 0.99 * len(real) > 1_000

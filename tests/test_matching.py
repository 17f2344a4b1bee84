"""Texts alike, nested leaves, best windows: against plain versions on awkward cases."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import audit, conflict, leaves, similarity


def grams(s):
    return {s[i : i + 2] for i in range(len(s) - 1)} if len(s) > 1 else ({s} if s else set())


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if grams(a) and grams(b) else 0.0


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    out = [None, "", "a", "a", "ab", "ba", "aaaa", "é€ßx", "é€ßx "]
    for size in (3, 8, 20, 40, 90, 90, 300):
        for _ in range(6):
            base = [random.choice("abcdefgh éß") for _ in range(size)]
            out.append("".join(base))
            for _ in range(3):
                copy = list(base)
                for _ in range(random.randint(0, 1 + size // 12)):
                    copy[random.randrange(size)] = random.choice("xyz")
                out.append("".join(copy))
    return out


@pytest.mark.parametrize("least", [0.85, 0.6])
def test_sets_alike(spark, texts, least):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    want = {(i, j) for j in range(len(texts)) for i in range(j) if texts[i] and texts[j] and jaccard(texts[i], texts[j]) >= least}
    got = similarity.sets_alike(rows, "id", "t", least=least).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 20
    assert all(abs(r["similarity"] - jaccard(texts[r["a"]], texts[r["b"]])) < 1e-12 for r in got)
    few = rows.filter("id % 5 = 0")
    two = {(r["a"], r["b"]) for r in similarity.sets_alike(few, "id", "t", rows, least).collect()}
    assert two == {(i, j) for i in range(0, len(texts), 5) for j in range(len(texts)) if texts[i] and texts[j] and jaccard(texts[i], texts[j]) >= least}


def test_no_pair_is_tried_for_each_two_rows(spark):
    """Texts of one length that have little in common hardly meet."""
    random.seed(5)
    rows = spark.createDataFrame([(i, "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(100))) for i in range(600)], "id long, t string")
    assert similarity.met(rows, None, "id", "t").count() < 600 * 599 / 2 / 50


def test_alike_by_blocks(spark, texts):
    """As by Python's own matcher, among pairs whose bigrams reach the lower bound."""
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")

    def plain(a, b):
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        return ratio if ratio > 0.9 else max(ratio, jaccard(a, b))

    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if texts[i] and texts[j] and jaccard(texts[i], texts[j]) >= 0.6]
    want = {(i, j): plain(texts[i], texts[j]) for i, j in pairs}
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.alike(rows, "id", "t", least=0.85, sets_from=0.6).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.85} and len(got) > sum(jaccard(texts[i], texts[j]) >= 0.85 for i, j in pairs)


def test_support_without_an_entity(spark):
    text = "the river rose by two metres in the spring of that year"
    rows = [("a1", "a", text, ["Rhine"]), ("b1", "b", text + "s", ["Rhone"]), ("b2", "b", text, ["rhine"]), ("c1", "c", "nothing of the kind was ever said about it", []), ("d1", "d", text, [])]
    claims = spark.createDataFrame(rows, "claim_id string, evidence_id string, claim string, entities array<string>")
    got = {(r["source_id"], r["target_id"]): (r["conflict_type"], r["confidence"], r["severity"]) for r in conflict.support_apart(claims).collect()}
    assert set(got) == {("a1", "b1"), ("a1", "d1"), ("b1", "d1"), ("b2", "d1")}  # a1 and b2 share one; b1 and b2 are of one evidence
    assert set(got.values()) == {("support", 0.95, "low")}


def string_leaves(value, path="$"):
    if isinstance(value, str):
        return [(path, value)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in string_leaves(v, f"{path}[{i}]")]
    return [x for k, v in value.items() for x in string_leaves(v, f"{path}.{k}")] if isinstance(value, dict) else []


def test_leaves(spark):
    values = [
        {"records": [{"question": "q?"}, {"answer": "500万元"}], "ignored": 42, "none": None, "deep": [[["x", []], {"y": {"z": "w"}}]], "blank": "  ", "": "unnamed"},
        "alone", [], {}, 7, ["a", {"b.c": "d", "e f": ["g", True]}],
    ]
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(10, "{not json but 预算"), (11, ""), (12, None), (13, '{"a": "1"} trailing')]
    got = sorted((r["id"], r["path"] or "", r["text"]) for r in leaves.leaves(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect())
    want = [(i, p, t) for i, v in enumerate(values) for p, t in string_leaves(v) if t.strip()]
    assert got == sorted([*want, (10, "", "{not json but 预算"), (13, "$.a", "1")])
    assert leaves.leaves(spark.createDataFrame([], "id int, t string"), "id", "t").count() == 0
    shallow = leaves.leaves(spark.createDataFrame(rows[:1], "id int, t string"), "id", "t", deepest=1).collect()
    assert [r["text"] for r in shallow] == ["unnamed"]


def test_leaves_of_files(spark):
    rows = [("data.json", None, '{"records": [{"question": "q"}]}'), ("mixed.jsonl", 2, '{"text": "t"}'), ("mixed.jsonl", 3, "not-json"), ("broken.json", None, "{x")]
    got = leaves.file_leaves(spark.createDataFrame(rows, "name string, line long, text string")).collect()
    assert {r["source_id"]: r["text"] for r in got} == {"data.json:$.records[0].question": "q", "mixed.jsonl:2:$.text": "t", "mixed.jsonl:3": "not-json", "broken.json": "{x"}


def window(item, body, n):
    own = {item[i : i + n] for i in range(len(item) - n + 1)} if len(item) >= n else {item}
    hits = [i for i in range(len(body) - n + 1) if body[i : i + n] in own]
    if not hits:
        return 0, 0, len(body)
    size, best = max(len(item), n), (-1, 0, 0)
    for right, at in enumerate(hits):
        left = next(k for k, h in enumerate(hits) if at - h <= size)
        if right - left > best[0]:
            best = (right - left, left, right)
    low = hits[best[1]]
    return best[0] + 1, low, min(len(body), max(low + size, hits[best[2]] + n))


def test_best_windows(spark):
    random.seed(7)
    items = [(i, "".join(random.choice("abc") for _ in range(random.choice([2, 5, 9])))) for i in range(12)]
    docs = [(j, "".join(random.choice("abc") for _ in range(random.choice([2, 30, 200])))) for j in range(12)]
    pairs = [(i, j) for i, _ in items for j, _ in docs if (i + j) % 3]
    frames = (spark.createDataFrame(x, f"{k} int, body string") for x, k in ((items, "item_id"), (docs, "doc_id")))
    got = audit.best_windows(spark.createDataFrame(pairs, "item_id int, doc_id int"), *frames, n=3).collect()
    assert {(r["item_id"], r["doc_id"]): (r["hits"], r["low"], r["high"]) for r in got} == {(i, j): window(items[i][1], docs[j][1], 3) for i, j in pairs}


def test_excerpts(spark):
    texts = [(1, "  Abc-d e! " + "filler, " * 40 + "xyz"), (2, "!!! abc"), (3, "x  y\n z" * 60)]
    items = spark.createDataFrame([(1, "abcde"), (2, "abc"), (3, "xyzxyz")], "item_id int, body string")
    pairs = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "item_id int, doc_id int")
    got = {r["item_id"]: r for r in audit.near_excerpts(pairs, items, spark.createDataFrame(texts, "doc_id int, text string"), n=3).collect()}
    assert texts[0][1][got[1]["start"] : got[1]["end"]] == "Abc-d e" and got[1]["excerpt"].startswith("Abc-d e! filler") and got[1]["excerpt"].endswith("…")
    assert got[2]["excerpt"] == "!!! abc" and (got[2]["start"], got[2]["end"]) == (4, 7)
    assert got[3]["excerpt"].strip("…").count("\n") == 0 and len(got[3]["excerpt"]) <= 162
    cut = spark.range(1).select(audit.excerpt(F.lit("0123456789" * 30), F.lit(150), F.lit(160)).alias("x")).first()["x"]
    assert cut == "…" + ("0123456789" * 30)[75:235] + "…"


@pytest.mark.parametrize(
    "text, want",
    [
        ("The NASA X-1 and GPT-4 met Alice in Paris; AB", ["The", "NASA", "GPT-4", "Alice", "Paris", "AB", "GPT"]),
        ("近日，欧盟AI法案正式生效。华为公司的昇腾芯片发布", ["AI", "欧盟AI法案", "AI法案", "华为公司"]),
        ("（关于清华大学的研究）、台积电3nm制程", ["清华大学", "台积电3nm制程"]),
        ("根据人工智能委员会消息", ["AI委员会"]),
        ("École Été abc DEF2x", ["DEF"]),
        ("", []),
    ],
)
def test_names(spark, text, want):
    from assay.functions.text import names

    assert spark.createDataFrame([(text,)], "t string").select(names(F.col("t")).alias("n")).first()["n"] == want


def test_anchors(spark):
    from assay.operators.anchors import anchored, title_names

    titles = spark.createDataFrame([("Tesla 华为公司销量 in 2023",), (None,), ("新能源市场、宁德时代电池",)], "t string")
    assert [r["n"] for r in titles.select(title_names(F.col("t")).alias("n")).collect()] == [["Tesla", "华为公司"], [], ["宁德时代电池"]]
    evidence = spark.createDataFrame([("e1", "Tesla results 2023", ["Berlin", "Austin"]), ("e2", None, None)], "evidence_id string, title string, entities array<string>")
    rows = [("e1", "sales rose in berlin", ["Q"], [], "sentence", False), ("e1", "x", [], ["2023"], "reported_claim", False), ("e1", "y", [], [], "sentence", True), ("e2", "z", ["Z"], [], "sentence", None), ("e3", "w", [], [], "sentence", None)]
    claims = spark.createDataFrame(rows, "evidence_id string, claim string, entities array<string>, times array<string>, span string, compares boolean")
    got = {r["claim"]: (r["entities"], r["times"]) for r in anchored(claims, evidence).collect()}
    assert got == {"sales rose in berlin": (["Q", "Tesla", "Berlin"], ["2023"]), "x": (["Tesla", "Berlin", "Austin"], ["2023"]), "y": (["Tesla", "Berlin", "Austin"], ["2023"]), "z": (["Z"], []), "w": ([], [])}


def plain_mentions(texts, patterns):
    out = set()
    inside = lambda c: c.isalnum() or c == "_"
    for k, t in texts:
        t, places = (t or "").lower(), []
        for p in {(p or "").lower() for p in patterns if (p or "").strip()}:
            places += [(i, i + len(p)) for i in range(len(t)) if t.startswith(p, i)]
        ok = [(a, z) for a, z in places if not (a and inside(t[a - 1]) and inside(t[a])) and not (z < len(t) and inside(t[z]) and inside(t[z - 1]))]
        last = 0
        for a, z in sorted(ok, key=lambda x: (x[0], -x[1])):
            if a >= last:
                out.add((k, t[a:z], a, z))
                last = z
    return out


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_mentions(spark, bound):
    """Longest, leftmost, none within another; by the automaton and by the join."""
    from assay.operators.anchors import mentions

    random.seed(2)
    words = ["new", "york", "city", "times", "école", "a_b", "x1"]
    texts = [(i, " ".join(random.choice(words) for _ in range(random.choice([0, 3, 40])))) for i in range(30)] + [(90, None), (91, "New-York, new york citys NEW YORK CITY"), (91, "york")]
    patterns = ["New York", "york city", "New York City Times", "city times new", "times", "école", "a_b x1", "x1", "", None, " ", "york"]
    got = mentions(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(p,) for p in patterns], "name string"), bound=bound)
    assert {tuple(r) for r in got.collect()} == plain_mentions(texts, patterns)
    assert mentions(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([], "name string"), bound=bound).count() == 0

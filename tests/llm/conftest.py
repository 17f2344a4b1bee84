import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
SHARED = " ".join(f"shared{i} passage{i * i}" for i in range(40))


def document_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    prose = lambda n: " ".join(rng.choice(words, n)) + f" end{n}"
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, " \t\n", None, "a", 3),
        (4, LONG * 3000, "en", "a", None),
        (5, prose(300), "de", "b", 10),
        (6, prose(50) + " " + SHARED + " " + prose(40), "de", "b", 10),
        (7, SHARED + "\nmail me at jo.do@mail.example.org or +49 30 1234567, card 4111 1111 1111 1111, host 10.0.0.255.", "fr", "c", 10),
        (8, "same text again and again, with ünïcode " * 12, "fr", None, 10),
        (9, "same text again and again, with ünïcode " * 12, "fr", "c", 10),
        (9, "same text again and again, with ünïcode " * 12, "fr", "c", 10),
        (None, "no id but a text of some length, licensed under the Apache License, Version 2.0.", "en", "b", 10),
        (None, None, None, None, None),
        (100, "Licensed under the Apache License, Version 2.0.", "en", "c", 40),
        (11, "a", "en", "b", 1),
        (12, "aa" * 4000, "en", "b", 1),
        (13, "12345 67890 !!! ???", "en", "b", 1),
    ]
    return rows + [(20 + i, prose(80), ("en", "de", "fr")[i % 3], "abc"[i % 3], 5) for i in range(30)]


def page_rows():
    """Null, empty, broken, very long, very deep and repeated pages; two hosts."""
    page = lambda body: f"<html><body><nav><a href='/'>Home</a></nav>{body}<footer>All rights</footer></body></html>"
    rows = [
        (1, "http://a.example/1", page("<article><h1>One</h1><p>Some &lt;text&gt;,\n  some <b>bo</b>ld.</p></article>")),
        (1, "http://a.example/1", page("<article><h1>One</h1><p>Some &lt;text&gt;,\n  some <b>bo</b>ld.</p></article>")),
        (2, "http://a.example/2", page("<article><h1>Two</h1><p>First<p>Second<br>line<ul><li>x<li>y</ul></article>")),
        (3, None, None),
        (4, "no url", ""),
        (None, None, "plain text &amp; no markup"),
        (5, "http://b.example/1", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (6, "http://b.example/2", page("<article>" + "<p>word word</p><h2>part</h2>" * 4000 + "</article>")),
        (7, "http://b.example/3", "<p>cut <a href='x"),
        (8, "http://b.example/4", "<article><p>open <!-- never closed <p>gone"),
        (9, "http://b.example/5", "<script>if (a < b) '</p>'</script><style>p {}</style><p>1 < 2 & 3</p></article></div>"),
    ]
    return rows


PAGES = "page_id long, url string, html string"
BENCHMARK = "item_id long, text string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, rows, schema, path, extra=()):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, schema)
    for name in extra:
        frame = frame.withColumn(name, F.lit(name))
    frame.repartition(3).write.mode("overwrite").parquet(path)


@pytest.fixture(scope="session")
def messy(spark, tmp_path_factory):
    """A folder of awkward tables; documents carry extra columns whose names clash with those of operators."""
    d = str(tmp_path_factory.mktemp("messy"))
    put(spark, document_rows(), DOCUMENTS, f"{d}/documents.parquet", ("rid", "key", "spans", "score", "size", "h", "fp", "lang_pred", "turn", "path"))
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    vectors = [(i, base[i % 20].tolist() if i < 40 else (base[i % 7] + 0.1 * rng.standard_normal(16)).tolist(), i % 3) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    vectors += [(60, None, 1), (61, [0.0] * 16, 1), (62, [nan] * 16, 1), (63, [inf] + [1.0] * 15, 1), (64, [None] + [1.0] * 15, 1), (65, [1.0, 2.0], 1), (66, [2.0, 4.0], None), (66, [2.0, 4.0], None), (None, base[0].tolist(), 1)]
    vectors += [(100, base[5].tolist(), 1), (100, base[5].tolist(), 1), (200, [3.0, 1.0], 1), (300, [7.0], 1)]
    put(spark, vectors, "vec_id long, embedding array<float>, label int", f"{d}/embeddings.parquet", ("rid", "weight", "rank", "list"))
    put(spark, page_rows(), PAGES, f"{d}/pages.parquet", ("host", "wrapper", "text", "n_chars"))
    put(spark, [(1, "the alpha beta\nGAMMA 12345"), (1, "the alpha beta\nGAMMA 12345"), (None, None), (3, "")], BENCHMARK, f"{d}/benchmark.parquet", ("bucket", "n"))
    return d


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nothing"))
    put(spark, [], DOCUMENTS, f"{d}/documents.parquet")
    put(spark, [], "vec_id long, embedding array<float>, label int", f"{d}/embeddings.parquet")
    put(spark, [], PAGES, f"{d}/pages.parquet")
    put(spark, [], BENCHMARK, f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="session")
def run(spark):
    from assay.llm.registry import QUERIES

    done = {}

    def get(name, folder):
        if (name, folder) not in done:
            done[name, folder] = QUERIES[name](spark, folder).collect()
        return done[name, folder]

    return get


@pytest.fixture(scope="session")
def rows_of(spark):
    def get(folder, table="documents"):
        return spark.read.parquet(f"{folder}/{table}.parquet").collect()

    return get

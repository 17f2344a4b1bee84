"""Phrases, page wrappers and resampling against plain versions, and their parts."""

import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from . import brute
from .conftest import SF, page_rows


def as_bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_phrases(run, rows_of, messy, folder):
    d = SF if folder == "small" else messy
    want = brute.collocations([(r["text"], r["lang"]) for r in rows_of(d)])
    assert want and as_bag(run("op11_phrases", d)) == as_bag(want)


@pytest.mark.parametrize("sampling", [{"share": 1, "sample_least": 1}, {"share": 4, "sample_least": 2}, {"share": 10_000, "sample_least": 50}])
def test_phrases_whatever_the_sample(spark, sampling):
    """A sample that proposes all, some or nothing: expansion passes end with the same phrases."""
    from assay.llm.phrases import collocations

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.collocations([(r["text"], r["lang"]) for r in docs.collect()], 4, 300)
    assert max(len(w[2].split(" ")) for w in want) == 5
    assert as_bag(collocations(docs, least=4, top=300, **sampling).collect()) == as_bag(want)


def test_phrases_expand(spark, monkeypatch):
    """A filter that holds many phrases by chance changes no count, and a pass counts only what none did before."""
    from assay.llm import phrases

    passes, counts, holds = [], phrases.counts, phrases._holds
    monkeypatch.setattr(phrases, "counts", lambda *a: passes.append(a) or counts(*a))
    monkeypatch.setattr(phrases, "_holds", lambda f, prints: holds(f, prints) | (prints % np.uint64(3) == 0))
    docs = spark.createDataFrame([(i, "das das das das das das; or the other way or the other way", "de") for i in range(9)], "doc_id long, text string, lang string")
    got = {r["phrase"]: r["n"] for r in phrases.frequent(docs, least=9, share=10_000, sample_least=50).collect()}
    assert len(passes) >= 2
    assert (got[""], got["das"], got["das das das das das"], got["or the other way or"], got["the other"]) == (126, 54, 18, 9, 18)


def test_phrases_in_parts(spark, monkeypatch):
    """Texts cut into small parts give the same counts."""
    from assay.llm import intern, phrases

    monkeypatch.setattr(intern, "WORDS", 7)
    data = "One two, one two three four five six seven. é two one".encode() * 9
    raw, offsets = np.frombuffer(data, np.uint8), np.array([0, 0, 60, len(data)])
    found = Counter()
    full = np.full(1 << 10, ~np.uint64(0))
    for part in intern.words(raw, offsets, phrases._WORD, phrases._BREAK, reach=4, size=64):
        for _, start, end, n in phrases._border(part, np.zeros(3, np.int64), np.zeros(1, np.uint64), 5, full, None):
            for a, b, c in zip(start, end, n, strict=True):
                found[part.data[a:b].tobytes().decode()] += int(c)
    want = brute.Counter()
    for text in (data[:60], data[60:]):
        for piece in brute.re.split(r"[.,;:!?\x0A-\x0D]", brute.lowered(text.decode())):
            ws = brute.re.findall(r"[^\x20\x09]+", piece)
            want.update(" ".join(ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    assert found == want


def test_interning():
    from assay.llm.intern import _PAD, Table, xxh64

    rng = np.random.default_rng(0)
    strings = [bytes(rng.integers(97, 100, n)) for n in (*range(0, 70), *range(0, 40), 500, 500)]
    strings += strings[::3]
    data = np.frombuffer(b"".join(strings) + b" " * _PAD, np.uint8)
    end = np.cumsum([len(s) for s in strings])
    start = end - np.array([len(s) for s in strings])
    for seed in (0, 42):
        assert xxh64(data, start, end, seed).tolist() == [xxhash.xxh64_intdigest(s, seed) for s in strings]
    for keys in (None, np.full(len(strings), 7, dtype=np.uint64)):  # with one key for all, bytes alone tell strings apart
        own = Table(data, len(strings))
        slots = own.put(start, end, keys)
        assert len(set(zip(slots.tolist(), strings, strict=True))) == len(set(strings)) == len(own.used())
        assert own.crc32(slots).tolist() == [zlib.crc32(s) for s in strings]


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_resampling(spark, run, rows_of, messy, folder):
    d = SF if folder == "small" else messy
    want = brute.resampled([(r["doc_id"], r["text"]) for r in rows_of(d)], [r["text"] for r in rows_of(d, "benchmark")])
    assert as_bag(run("op13_resampling", d)) == as_bag(want)


@pytest.mark.parametrize("n, percent", [(2, 50), (3, 100), (2, 0)])
def test_resampling_longer_features(spark, messy, rows_of, n, percent):
    from assay.llm.resampling import resampled

    docs, target = (spark.read.parquet(f"{messy}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], n, 50, percent, 5)
    got = resampled(docs, target, n, 50, percent, 5).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert as_bag(got) == as_bag(want)


def test_resampling_ties(spark):
    """A third of the rows are one row; ranks run through its copies without a gap."""
    from assay.llm.resampling import drawn

    rows = [(None if i % 3 else i, 30, 30, 5, 100 if i % 3 else i) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(4)
    got = drawn(frame, 70, 20).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 211))
    order = [r["score"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert order == sorted(order, reverse=True) == sorted((r[4] for r in rows), reverse=True)[:210]


WANT = {
    1: "One Some <text>, some bold.",
    2: "Two First Second line x y",
    3: "",
    4: "",
    None: "plain text & no markup",
    5: "deep",
    6: " ".join(["word word part"] * 4000),
    7: "cut",
    8: "open",
    9: "1 < 2 & 3",
}


def test_html_awkward(run, messy):
    got = run("op12_html", messy)
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in got) == Counter((i, WANT[i], len(WANT[i])) for i, _, _ in page_rows())


def test_html_small(run, rows_of):
    """The given pages have one article; what is in it, by Python's own parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.inside = [""], False

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            self.blocks += [""] * (tag not in ("b", "i", "a", "span"))

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            self.blocks += [""] * (tag not in ("b", "i", "a", "span"))

        def handle_data(self, data):
            self.blocks[-1] += data * self.inside

    want = {}
    for r in rows_of(SF, "pages"):
        parser = Article()
        parser.feed(r["html"])
        parser.close()
        want[r["page_id"]] = " ".join(filter(None, (" ".join(b.split()) for b in parser.blocks)))
    assert {r["page_id"]: r["text"] for r in run("op12_html", SF)} == want


LAYOUTS = [
    "<div id='site-header'>The Daily <a>log in</a></div><div class='menu'><a>News</a> <a>Sport</a></div><main><h1>{t}</h1>{body}</main><div class='sidebar-right'>Popular</div>",
    "<header>Logo</header><article class='post post-{i}'><header><h1>{t}</h1></header>{body}<div class='share'>Share this</div><section id='comments'><article class='comment'><p>First!</p></article></section></article>",
    "<div><a>Home</a> | <a>About</a></div><div><h1>{t}</h1>{body}</div><div>Copyright by us. Call {same} for details.</div>",
    "<div role='banner'>Brand</div><div class='content-with-sidebar'><h2>{t}</h2>{body}</div><div class='cookieNotice cookie-bar'>We use cookies</div><form><p>Subscribe</p><input></form>",
    "<table><tr><td><ul><li><a>one</a><li><a>two</a></ul><td itemprop='articleBody'><h1>{t}</h1>{body}</table><dialog>Sale!</dialog>",
]


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_html_layouts(spark, layout):
    """Main text by element, role, class, property and, where none says it, by what the pages of a host share."""
    from assay.llm.wrappers import extracted

    rows, want = [], {}
    for i in range(12):
        paragraphs = [f"Story {i} has paragraph {k} with &eacute; and <em>em</em>phasis." for k in range(1 + i % 4)]
        body = "".join(f"<p>{p}</p>" for p in paragraphs) + ("<ul><li>item</li><li>other item %d</li></ul>" % i) * (i % 3 == 1) + "<h2>Part</h2><p>More of %d</p>" % i * (i % 5 == 2)
        rows.append((i, f"https://site.example/{i}", "<html><body>" + LAYOUTS[layout].format(t=f"Title {i}", body=body, i=i, same=555) + "</body></html>"))
        want[i] = " ".join([f"Title {i}", *(p.replace("&eacute;", "é").replace("<em>em</em>", "em") for p in paragraphs), *([f"item other item {i}"] * (i % 3 == 1)), *([f"Part More of {i}"] * (i % 5 == 2))])
    got = {r["page_id"]: r["text"] for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want


def test_html_in_rounds(spark, monkeypatch):
    """Small groups take more rounds to one wrapper a host, and joined wrappers give what broadcast ones do."""
    from assay.llm import wrappers

    pages = spark.createDataFrame([(i, "http://h.example/", "<body>" + "".join(f"<{t}>x{i}</{t}>" for t in "pre h1 ul p dl h2".split()[i % 5 :]) + f"<p>c{i}</p>" * (i % 7)) for i in range(60)], "page_id long, url string, html string").repartition(6)
    one = sorted(map(tuple, wrappers.extracted(pages).collect()))
    monkeypatch.setattr(wrappers, "SHAPES", 3)
    monkeypatch.setattr(wrappers, "SENT", 0)
    assert wrappers.infer(pages).count() == 1
    assert sorted(map(tuple, wrappers.extracted(pages).collect())) == one


def test_expressions():
    """Mismatches become optional, repetitions are folded, and alignment takes any order."""
    from assay.llm.markup import merged, parse

    pages = ["<p>a</p><h2>b</h2><p>c</p>", "<p>a</p><table><tr><td>x</table>", "<p>a<p>b<p>c<p>d"]
    trees = [parse(p)[0] for p in pages]
    assert trees[2].shape() == "page(p*(#*))"
    both = merged(trees[0], trees[1], True)
    assert both.shape() == "page(p(#) h2?(#) p?(#) table?(tr(td(#))))"
    assert [s.pages for s in both.slots()] == [2, 1, 1, 1] and both.slots()[0].text is not None and merged(trees[0], trees[2], True).slots()[0].text is None


@pytest.mark.parametrize("name", ["op11_phrases", "op12_html", "op13_resampling"])
def test_no_rows(run, nothing, name):
    assert run(name, nothing) == []


@pytest.mark.parametrize("name", ["op11_phrases", "op12_html", "op13_resampling"])
def test_sql(spark, run, name):
    """The queries against their SQL, which is written from the contract."""
    import duckdb

    from assay.llm.registry import ORACLES

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    got = run(name, SF)
    assert Counter(tuple(r[k] for k in want.columns) for r in got) == Counter(want.fetchall())

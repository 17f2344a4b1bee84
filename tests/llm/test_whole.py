"""Cases that once were left out: each operator against the whole of its job."""

from collections import defaultdict
from itertools import product

from pyspark.sql import functions as F

from .brute import components


def test_simhash_ties_of_long_lists():
    """Lists of several hundred members that differ in two bytes, the top ones included, against all pairs."""
    import numpy as np

    from assay.llm.simhash import ties

    rng = np.random.default_rng(11)
    for first, second in [(56, 48), (8, 0), (56, 0), (32, 24), (56, 8)]:
        base = 0 if (first, second) == (8, 0) else int(rng.integers(0, 2**63)) << 1
        base &= ~((0xFF << first) | (0xFF << second))
        members = sorted({base | int(a) << first | int(b) << second for a, b in rng.integers(0, 256, (400, 2))})
        root = {m: m for m in members}

        def find(m, root=root):
            while root[m] != m:
                m = root[m]
            return m

        for i, a in enumerate(members):
            for b in members[:i]:
                if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                    root[max(find(a), find(b))] = min(find(a), find(b))
        assert len(members) > 300 and sorted(ties(members)) == [(m, find(m)) for m in members if find(m) != m]


def test_simhash_top_bits_in_a_long_list():
    """Two fingerprints that differ in bits 63 and 62 alone, among unlinked members of one list."""
    from assay.llm.simhash import ties

    low = 0x00BED9D99A2086C5 & ~(0xFF << 48)
    pair = [low | 0x87 << 56, low | 0x47 << 56]
    # three or more bits of the second byte apart from both, and from each other
    apart = [low | a << 56 | b << 48 for a in range(0, 256) for b in (0x3F, 0xF8)]
    parts = defaultdict(set)
    for m, r in ties([*pair, *apart]):
        parts[r].add(m)
    assert any(set(pair) <= {r, *ms} for r, ms in parts.items())


def test_simhash_short_and_long_lists(spark):
    """Clusters of near fingerprints, beyond and below the length at which lists are posted again, against all pairs."""
    import numpy as np
    from assay.llm.simhash import FEW, links

    rng = np.random.default_rng(6)
    prints = {int(x) for x in rng.integers(0, 2**63, 400)}
    for size in (40, 3 * FEW):
        base = int(rng.integers(0, 2**63))
        for _ in range(size):
            m = base
            for bit in rng.integers(0, 64, int(rng.integers(0, 5))):
                m ^= 1 << int(bit)
            prints.add(m)
    members = sorted(prints)
    x = np.array(members, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    want = components(members, [(members[i], members[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    signed = [(int(v),) for v in x.view(np.int64)]
    found = links(spark.createDataFrame(signed, "fp long")).collect()
    pairs = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in found]
    assert components(members, pairs) == want


def test_prefix_doubling_ranks(spark):
    """Ranks by growing lengths put positions in the order of their pairs and drop what is unique, whatever the reach."""
    from assay.llm.suffix import doubled

    words = {0: "abcabcab", 1: "abcabcaz", 2: "xbcabcab", 3: "abcabcab", 4: "abc"}
    rows = [(o, t - 2, ord(c)) for o, w in words.items() for t, c in enumerate(w)]
    names = spark.createDataFrame(rows, "oid long, t int, name long")
    for reach in (1, 2, 3, 5, 7, 8):
        strings = {(o, t - 2): w[t : t + reach] for o, w in words.items() for t in range(len(w) - reach + 1)}
        many = [k for k, v in strings.items() if list(strings.values()).count(v) > 1]
        got = {(r["oid"], r["t"]): r["rank"] for r in doubled(names, reach).collect()}
        assert set(got) == set(many)
        assert all((got[a] == got[b]) == (strings[a] == strings[b]) for a in many for b in many)
        if reach == 1:
            assert all((got[a] < got[b]) == (strings[a] < strings[b]) for a in many for b in many)


def test_substrings_of_other_lengths(spark):
    """The threshold and the step are parameters: against brute force on texts of few letters."""
    import numpy as np

    from assay.llm.suffix import digest

    from .brute import bytes_removed

    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab"), n)) for n in (300, 200, 90, 40, 7, 0)]
    texts += [texts[0][40:160] + "c" + texts[1][:70], "x" * 80, texts[2], "q" + texts[3] + "r"]
    rows = list(enumerate(texts))
    for length, anchor in ((12, 4), (30, 7), (64, 16)):
        want = bytes_removed(rows, length)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in digest(spark.createDataFrame(rows, "doc_id long, text string"), length, anchor).collect()}
        assert got == want


def test_substring_index_takes_later_batches(spark):
    """Three batches into an index that is kept, compacted and opened again: a later batch wakes earlier documents, whichever run holds them."""
    import numpy as np

    from assay.llm.repeats import repeats
    from assay.llm.scan import Unit, word_symbols
    from assay.llm.substring import Index, add_batch, together

    from .brute import _removed

    rng = np.random.default_rng(12)
    words = lambda n: rng.integers(0, 50, n).astype(str).tolist()
    shared = [words(60), words(70), words(45)]
    docs = [words(30) + shared[0] + words(20), words(80), words(40) + shared[1], words(25), shared[0][5:55] + words(30) + shared[2], shared[1] + words(20), words(10) + shared[2] + words(5), words(5)]
    batches, unit = [[0, 1, 2], [3, 4], [5, 6, 7]], Unit(word_symbols, 35, 6)
    every = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "rid long, text string")
    index, found = Index(spark, buckets=4, fan_in=2), []
    try:
        for b in batches:
            index = Index(spark, buckets=4, fan_in=2, runs=tuple(index.runs))
            found += add_batch(index, every.filter(every["rid"].isin(b)), unit)
            assert len(index.runs) == 1
        spans = repeats(every, together(found, len(batches)).withColumn("alike", F.lit(False)), unit).collect()
    finally:
        index.drop()
    gone = [np.zeros(len(d), dtype=bool) for d in docs]
    for r in spans:
        for low in range(r["low"], r["high"] + 1):
            gone[r["rid"]][low : low + 35] = True
    for got, want in zip(gone, _removed(docs, 35), strict=True):
        assert (got == want).all()
    assert all(gone[i].any() for i in (0, 2, 4, 5, 6))


def test_pii_ibans_before_capitals_and_digits():
    from assay.llm.pii import masked, spans_of

    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    cases = {
        f"{gb} BIC WESTGB22": [gb],
        f"pay {de} 2024": [de],
        "GB82WEST12345698765432 EUR 500": ["GB82WEST12345698765432"],
        f"{gb} please": [gb],
        f"AB12 {gb} {de} X": [gb, de],
        f"{gb[:-1]}3 BIC WESTGB22": [],
        "GB82WEST12345698765432X": [],
        "NO93 8601 1117 947 NOK": ["NO93 8601 1117 947"],
    }
    for text, want in cases.items():
        assert [text[s:e] for kind, s, e, _ in spans_of(text) if kind == "iban"] == want
        assert not any(w in masked(text, 0.5) for w in want)


def test_pii_context_decides():
    """Words on either side, in four languages, raise and lower scores, and let added spans in or keep them out."""
    from assay.llm.pii import KEEP, masked, spans_of

    score = lambda text, kind: next((s for k, _, _, s in spans_of(text) if k == kind), None)
    plain = score("see 10.20.30.40 there", "ip")
    for text in ("host 10.20.30.40", "10.20.30.40 is the server", "Adresse 10.20.30.40", "le serveur 10.20.30.40", "servidor 10.20.30.40"):
        assert score(text, "ip") > plain
    assert score("firmware version 10.20.30.40", "ip") < plain and "10.20.30.40" in masked("firmware version 10.20.30.40", 0.3)
    iban = "GB82 WEST 1234 5698 7654 32"
    assert score(f"transfer to {iban}", "iban") > score(f"x {iban}", "iban") >= KEEP and score(f"Mustermann, {iban}", "iban") is None
    assert score("her social security number is 123-45-6789", "ssn") >= KEEP
    assert score("item 123-45-6789", "ssn") is None and score("social security, order 123-45-6789", "ssn") is None
    for text in ("Anruf unter 030 123 4567", "(030) 123-4567, t\u00e9l\u00e9phone", "m\u00f3vil 0612 345 678", "call 0612 345 678"):
        assert score(text, "tel") >= KEEP
    assert score("row 0612 345 678", "tel") is None
    assert [k for k, *_ in spans_of("call +49 030 123 4567")] == ["phone"]


LABELLED = "doc_id long, text string, lang string"


def test_langid_long_runs(spark):
    """Two scripts without spaces: a run's middle decides, and it weighs by its length."""
    import numpy as np

    from assay.llm.langid import Scorer, fit, grams_of, words_of

    rng = np.random.default_rng(2)
    a, b = "abcdefgh", "stuvwxyz"
    text = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = [(i, text(a, 300) + " " + text(a, 5), "aa") for i in range(20)] + [(20 + i, text(b, 300) + " " + text(b, 5), "bb") for i in range(20)]
    scorer = Scorer(fit(spark.createDataFrame(rows, LABELLED)))
    mixed = text(a, 40) + text(b, 9_000) + text(a, 40)
    assert scorer.predict([mixed, " ".join([text(a, 5) for _ in range(9)]) + " " + text(b, 10_000)])[0] == ["bb", "bb"]
    for size in (64, 65, 127, 128, 129, 1000):
        run = text(a + b, size)
        for n in range(1, 6):
            got = [g for w in words_of(run) for g in grams_of(w, n)]
            assert got == [f"^{run}$"[i : i + n] for i in range(size + 3 - n)]


def test_langid_learns_rare_languages(spark):
    """A language with a few of many rows is in the sample, and all words of the sample are in the model, counted over all batches."""
    from assay.llm.langid import Scorer, fit

    vowels = ["".join(c) for c in product("bcdfg", "aeiou", "lmnrs", "aeiou")]
    many = [(i, " ".join(vowels[(i * 7 + j) % 600] for j in range(30)), "aa") for i in range(4000)]
    few = [(5000 + i, "kivi kala jarvi talo puu", "fi") for i in range(3)]
    model = fit(spark.createDataFrame(many + few, LABELLED).repartition(8), fit_rows=200)
    assert model.langs == ["aa", "fi"] and (model.rows(0, ["kivi", "kala", "jarvi", "talo", "puu"]) >= 0).all()
    assert Scorer(model).predict(["kala talo", vowels[5]])[0] == ["fi", "aa"]
    whole = fit(spark.createDataFrame(many[:64] * 2 + few, LABELLED).repartition(8))
    kivi, puu = whole.rows(0, ["kivi", "puu"])
    assert whole.logs[0][kivi, 1] == whole.logs[0][puu, 1] > whole.logs[0][kivi, 0]


def test_ann_prunes_where_vectors_cluster():
    """20,000 vectors in 800 groups: few rows are read, and copies leave no query short of neighbours."""
    import numpy as np

    from assay.llm.ann import COPIES, LIST_ROWS, K, Index, Centroids

    rng = np.random.default_rng(4)
    x = rng.standard_normal((800, 48))[rng.integers(0, 800, 20_000)] + 0.35 * rng.standard_normal((20_000, 48))
    index = Index({48: Centroids(x[:10_000], len(x) // LIST_ROWS)})
    lists = [[] for _ in range(index.lists)]
    for rows, where in index.post(x):
        for r, w in zip(rows.tolist(), where.tolist(), strict=True):
            lists[w].append(r)
    index.sized({i: len(rows) for i, rows in enumerate(lists)})
    hits = read = 0
    for q in range(0, 20_000, 200):
        found = np.unique(np.concatenate([lists[i] for i in index.search(x[q], K)]).astype(int))
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:K]) & set(found.tolist()))
        read += len(found)
    assert hits >= 0.95 * 100 * K and read <= 0.1 * 100 * len(x)
    index.sized(dict.fromkeys(range(index.lists), 3))
    assert all(3 * len(index.search(x[q], K)) >= COPIES * (K + 1) for q in range(0, 20_000, 2_000))


def test_ann_groups_of_copies(spark):
    """Groups of five copies in small lists: every query gets ten neighbours, its copies first."""
    import numpy as np
    from pyspark.sql import functions as F

    from assay.llm.ann import search

    rng = np.random.default_rng(8)
    base = rng.standard_normal((800, 8))
    rows = [(i, base[i % 800].tolist()) for i in range(4_000)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r)
    assert len(by) == 40
    for q, hits in by.items():
        assert len(hits) == 10 and {r["vec_id"] for r in hits if r["rank"] <= 4} == {i for i in range(q % 800, 4_000, 800) if i != q}

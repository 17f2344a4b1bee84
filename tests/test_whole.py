"""Cases that once were left out: each operator against the whole of its job."""


def test_dynamic_goes_on_until_covered(spark):
    """Six words in six documents, one found a round, until five are; and ten documents in the first round."""
    from assay.operators import scorers

    words = ["amber", "birch", "cedar", "dunes", "ember", "fjord"]
    rows = [(i, w + " " + " ".join(f"filler{i}x{j}" for j in range(5))) for i, w in enumerate(words)] + [(10 + i, f"other{i} text{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(words))], "query_id long, query string")
    got = scorers.dynamic(docs, asked, k=1).collect()
    assert sorted((r["round"], r["doc_id"]) for r in got) == [(i, i) for i in range(5)]
    same = spark.createDataFrame([(i, f"cedar filler{i}") for i in range(12)] + [(20 + i, f"other{i}") for i in range(30)], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "cedar")], "query_id long, query string")
    got = scorers.dynamic(same, ask).collect()
    assert len(got) == 10 and {r["round"] for r in got} == {0}

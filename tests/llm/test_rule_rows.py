"""The rules' verdict on whole rows comes from the ledger and keeps every column."""

from chronolith.llm import quality_rules


def test_accepted_rows_with_odd_columns(spark):
    good = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, good, 5, "r"), (1, "few", 5, "r"), (None, good, None, None), (2, None, 1, "r")], "doc_id long, text string, `a.b` int, n_words string")
    out = quality_rules.accepted(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, (r for r in docs.collect() if r.text == good)))

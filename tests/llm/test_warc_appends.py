"""Several write jobs into one folder."""

from chronolith.llm import warc


def test_appends_keep_earlier_archives(spark, tmp_path):
    at = f"file://{tmp_path}/w"
    for ids in ((1, 2, 3), (4, 5)):
        warc.pages_to_warc(spark.createDataFrame([(i, f"http://{i}", f"<p>{i}</p>") for i in ids], "page_id long, url string, html string"), at)
    assert sorted(x.page_id for x in warc.read_warc(spark, at).select("page_id").collect()) == list("12345")
    # an abort takes only what its own job wrote
    late = warc.WarcWriter(at)
    other = tmp_path / "w" / f"pages-{late.job}-000000-1.warc.gz"
    other.write_bytes(b"")
    late.abort([])
    assert not other.exists()
    assert warc.read_warc(spark, at).count() == 5

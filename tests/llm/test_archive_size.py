"""What the archive takes on disk."""

from evidq.llm import warc


def test_stored_texts_are_packed_well(spark):
    rows = [(i, f"http://a/{i}", f"<p>page {i} " + "some words of a page, " * 200) for i in range(50)]
    headers, payloads = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    files = [f for table in (headers, payloads) for f in table.inputFiles()]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert {r.page_id: r.payload.decode() for r in warc.parsed(warc.records(headers, payloads)).collect()} == {i: h for i, _, h in rows}

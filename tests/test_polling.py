"""The paged source polled as a stream, from files that grow."""

import json

from barloom.sources.rest import PagedSource, PollingReader

COLUMNS = ["open", "close", "high", "low", "value", "volume", "begin", "end"]


def page(folder, ticker, start, n):
    rows = [[1, 2, 3, 0.5, 10, 5, f"2024-01-01 {start + i:02d}:00:00", f"2024-01-01 {start + i:02d}:59:59"] for i in range(n)]
    (folder / f"{ticker}_{start}.json").write_text(json.dumps({"candles": {"columns": COLUMNS, "data": rows}}))


def test_polling(spark, tmp_path):
    """Whole pages until a short one; the next batch goes on behind the rows taken; a range read again gives the same."""
    src = tmp_path / "src"
    src.mkdir()
    for ticker, sizes in (("A", (2, 1)), ("B", (1,))):
        for k, n in enumerate(sizes):
            page(src, ticker, 2 * k, n)
    options = {"url": f"file://{src}", "tickers": "A,B", "page": "2"}
    reader = PollingReader(options)
    first, end = reader.read(reader.initialOffset())
    first = list(first)
    assert end == {"A": 3, "B": 1} and [(t, at) for t, at, _ in first] == [("A", 0), ("A", 2), ("B", 0)]
    assert list(reader.readBetweenOffsets(reader.initialOffset(), end)) == first
    page(src, "A", 3, 0)
    page(src, "B", 1, 2)
    page(src, "B", 3, 0)
    more, then = reader.read(end)
    assert then == {"A": 3, "B": 3} and [(t, at) for t, at, _ in more] == [("B", 1)]
    spark.dataSource.register(PagedSource)
    q = spark.readStream.format("paged_json").options(**options).load().writeStream.format("memory").queryName("pages").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r["ticker"], r["page"]) for r in spark.table("pages").collect()) == [("A", 0), ("A", 2), ("B", 0), ("B", 1)]

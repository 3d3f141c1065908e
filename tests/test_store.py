"""What is stored more than once, sources that fail for a while, and times in other zones."""

import datetime as dt
import http.server
import json
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.functions import flexible_time
from barloom.operators.clean import clean_candles, gated
from barloom.plans import routes
from barloom.registry import ORACLE_SQL, QUERIES
from barloom.session import CANDLE_COLUMNS, INGESTED
from barloom.sources import files, rest, sinks


def test_copies_go_by_where_they_were_stored(spark, tmp_path):
    """Stored twice: 100 rows by two names, 50 after cleaning, the later ones; stored under the same name: replaced."""
    c, at = files.mock_candles(spark, 50), str(tmp_path / "raw")
    sinks.save_candles(c, at)
    sinks.save_candles(c, at)
    assert files.load_candles(spark, at).count() == 50
    sinks.save_candles(c.where("begin > timestamp_ntz'2024-01-01 10:00:00'").withColumns({x: F.col(x) * 2 for x in ("open", "high", "low", "close")}), at)
    rows = files.load_candles(spark, at)
    assert rows.count() == 89 and INGESTED in rows.columns and "stored_batch" not in rows.columns
    got = {r["begin"]: r["close"] for r in clean_candles(rows).collect()}
    want = {r["begin"]: r["close"] * (2 if r["begin"] > dt.datetime(2024, 1, 1, 10) else 1) for r in c.collect()}
    assert got == want and INGESTED not in clean_candles(rows).columns
    assert files.load_candles(spark, at, ticker="SBER", timeframe="1H").count() == 89


def test_copies_without_provenance(spark):
    """Then the last row of the table stays; a bad last copy takes the good one's place and goes."""
    c = files.mock_candles(spark, 20).coalesce(1)
    later = c.limit(5).withColumn("close", F.lit(-1.0))
    assert clean_candles(c.union(c)).count() == 20 and clean_candles(c.union(later)).count() == 15 and clean_candles(later.union(c)).count() == 20
    assert clean_candles(c.limit(0)).count() == 0


def test_rows_of_one_file(spark, tmp_path):
    """Of copies within a file the last one stays."""
    (tmp_path / "a.csv").write_text("Date,O,H,L,C,Vol,tic,tf\n2024-01-01,1,2,0.5,1.5,10,A,1D\n2024-01-02,1,2,0.5,1.5,10,A,1D\n2024-01-01,1,2,0.5,1.75,10,A,1D\n")
    got = {r["begin"].day: r["close"] for r in clean_candles(files.load_candles(spark, str(tmp_path / "a.csv"))).collect()}
    assert got == {1: 1.75, 2: 1.5}


def test_ledger(spark, tmp_path):
    """Good files by their rows, a broken one with none; loading goes on and says so."""
    c = files.mock_candles(spark, 30).select(*CANDLE_COLUMNS)
    for k in range(3):
        c.where(F.hour("begin") % 3 == k).toPandas().to_parquet(tmp_path / f"part {k}+.parquet")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 nothing")
    got = {r["path"].rsplit("/", 1)[-1]: r["n_rows"] for r in files.file_ledger(spark, str(tmp_path), "parquet").collect()}
    assert sorted(got.values()) == [0, 10, 10, 10] and got["broken.parquet"] == 0
    with pytest.warns(UserWarning, match="1 files"):
        assert files.load_candles(spark, str(tmp_path)).count() == 30


@pytest.mark.parametrize("price", [0.0, 1.0])
def test_gate_that_lets_none_pass(spark, tmp_path, price):
    """Where all batches are unfit the store has no candles, as in SQL, and no error; where some are fit they are there."""
    at = str(tmp_path / "events.parquet")
    hours = spark.range(48).select(F.lit("A").alias("event_type"), (F.expr("timestamp_ntz'2024-01-07'") + F.expr("interval 1 hour") * F.col("id")).alias("ts"), F.lit(price).alias("value"))
    hours.coalesce(1).write.parquet(at)
    got = QUERIES["gated_store"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/*.parquet'")
    want = duck.execute(ORACLE_SQL["gated_store"]).fetchall()
    assert got.columns == ["ticker", "begin", "close", "volume"] and sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 24 * price
    with pytest.raises(ValueError, match="no candles"):
        files.stored_candles(spark, str(tmp_path / "nowhere"))


def test_empty_store(spark, tmp_path):
    """A store without a batch has the columns of one with batches, and they can be cleaned."""
    c = files.mock_candles(spark, 5)
    for name, rows in (("some", c), ("none", c.limit(0))):
        sinks.save_candles(rows, str(tmp_path / name))
    some, none = (files.stored_candles(spark, str(tmp_path / x)) for x in ("some", "none"))
    assert some.count() == 5 and none.count() == 0 and clean_candles(none).count() == 0
    assert {(f.name, f.dataType.simpleString()) for f in some.schema} <= {(f.name, f.dataType.simpleString()) for f in none.schema}


def test_gate(spark):
    """Rows in the order they came first, then the batch by time; nulls are faults; a fit batch has no verdict."""
    c = [x.asDict() for x in files.mock_candles(spark, 3).collect()]
    def batch(name, *changes):
        rows = [dict(x, batch=name, row=i) for i, x in enumerate(c)]
        for i, change in changes:
            rows[i] |= change
        return rows
    made = [
        *batch("fit"), *batch("two", (1, {"high": 0.1, "open": 0.2, "close": 0.2, "low": 0.3}), (2, {"volume": 0.0})), *batch("null", (2, {"close": None})), *batch("late", (0, {"end": dt.datetime(2025, 1, 1)})),
        *batch("same", (2, {"begin": c[1]["begin"], "end": c[1]["end"]})), *batch("other", (1, {"ticker": "X"})), *batch("frame", (2, {"timeframe": "1D"})), *batch("none", (0, {"begin": None})),
    ]
    rows = spark.createDataFrame([tuple(x[k] for k in (*CANDLE_COLUMNS, "batch", "row")) for x in made], files.CANDLES.add("batch", "string").add("row", "long")).repartition(4)
    got = {r["batch"]: (r["rejected_row"], r["rejected_rule"]) for r in gated(rows, ("batch",)).collect()}
    assert got == {
        "fit": (None, None), "two": (1, "high below low"), "null": (2, "price not positive"), "late": (1, "overlaps the candle before"), "same": (2, "duplicate begin"), "other": (1, "several tickers"), "frame": (2, "several timeframes"), "none": (0, "no begin"),
    }
    assert gated(rows.limit(0), ("batch",)).count() == 0


class Failing(http.server.BaseHTTPRequestHandler):
    answers: list[int] = []
    asked: list[str] = []

    def do_GET(self):
        self.asked.append(self.path)
        code = self.answers.pop(0) if self.answers else 200
        self.send_response(code)
        self.end_headers()
        start = int(self.path.partition("start=")[2] or 0)
        rows = [[f"2024-01-01 {h:02d}:00:00"] for h in range(start, min(start + 2, 3))]
        self.wfile.write(json.dumps({"candles": {"columns": ["begin"], "data": rows}}).encode() if code == 200 else b"oops")

    def log_message(self, *a):
        pass


def test_tries():
    """Answers of 500 and above and failed connections are tried again with longer pauses, others are not."""
    server = http.server.HTTPServer(("127.0.0.1", 0), Failing)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, paused = f"http://127.0.0.1:{server.server_port}/x", []
    try:
        Failing.answers[:] = [500, 503]
        assert b"candles" in rest.fetched(url, {}, paused.append) and paused == [0.2, 0.4]
        Failing.answers[:] = [404]
        with pytest.raises(RuntimeError, match="404"):
            rest.fetched(url, {}, paused.append)
        Failing.answers[:] = [500, 500, 500]
        with pytest.raises(RuntimeError, match="500.*oops"):
            rest.fetched(url, {"pause": "1"}, paused.append)
        assert paused == [0.2, 0.4, 1, 2]
        Failing.answers.clear()
        Failing.asked.clear()
        reader = rest.PagedReader({"url": url[:-2], "tickers": "A,B", "from": "2024-01-01", "till": "2024-01-10", "range_days": "4", "page": "2"})
        parts = reader.partitions()
        assert [(p.ticker, p.begin, p.end) for p in parts[:3]] == [("A", "2024-01-01", "2024-01-04"), ("A", "2024-01-05", "2024-01-08"), ("A", "2024-01-09", "2024-01-10")] and len(parts) == 6
        assert [n for _, n, _ in reader.read(parts[1])] == [0, 1] and all("from=2024-01-05&till=2024-01-08" in x for x in Failing.asked)
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(OSError):
        rest.fetched(url, {"timeout": "1"}, paused.append)
    assert paused[4:] == [0.2, 0.4]


def test_paths():
    assert rest.json_path("/iss/engines/") == "/iss/engines.json" and rest.json_path("iss") == "/iss.json"
    for bad in ("/iss/x?y=1", "/other/x", "/iss/x.csv", ""):
        with pytest.raises(ValueError):
            rest.json_path(bad)
    assert rest.day_ranges("2024-02-28", "2024-02-28", 92) == [("2024-02-28", "2024-02-28")] and rest.day_ranges("2024-02-02", "2024-02-01", 5) == []


def test_stream_goes_on(spark, tmp_path):
    """Two runs over a mirror that grows: each candle once, and a range read again gives the same."""
    def put(day, start, hours):
        rows = [[1, 2, 3, 0.5, 10, 5, f"{day}T{h:02d}:00:00" if h % 2 else f"{day} {h:02d}:00:00", f"{day} {h:02d}:59:59"] for h in hours]
        at = tmp_path / f"pages/ticker=A/from={day}/start={start}"
        at.mkdir(parents=True, exist_ok=True)
        (at / "part-0.txt").write_text(json.dumps({"candles": {"columns": ["open", "close", "high", "low", "value", "volume", "begin", "end"], "data": rows}}))

    put("2024-01-01", 0, range(3))
    put("2024-01-01", 3, range(3, 5))
    options = {"url": f"file://{tmp_path}/pages", "tickers": "A", "from": "2024-01-01", "range_days": "1", "page": "3", "mirror": "yes", "clock": f"file://{tmp_path}/clock"}
    spark.dataSource.register(rest.PagedSource)

    def run(clock):
        (tmp_path / "clock").write_text(clock)
        rows = spark.readStream.format("paged_json").options(**options).load()
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        bodies = [json.loads(r["json"]) for r in spark.read.schema("ticker string, page int, json string").parquet(str(tmp_path / "out")).collect()]
        return sorted(r[6].replace("T", " ") for b in bodies for r in b["candles"]["data"])

    assert run("2024-01-01 04:00:00") == [f"2024-01-01 {h:02d}:00:00" for h in range(4)]
    put("2024-01-01", 3, range(3, 6))
    put("2024-01-02", 0, range(2))
    assert run("2024-01-01T04:00:00") == [f"2024-01-01 {h:02d}:00:00" for h in range(4)]
    want = [f"2024-01-01 {h:02d}:00:00" for h in range(6)] + ["2024-01-02 00:00:00"]
    assert run("2024-01-02 01:00:00") == want
    reader = rest.RangeStreamReader(options)
    again = [row for p in reader.partitions({"until": "2024-01-01 01:00:00"}, {"until": "2024-01-02 01:00:00"}) for row in reader.read(p)]
    assert sum(len(json.loads(j)["candles"]["data"]) for *_, j in again) == 6 and reader.partitions({"until": "2024-01-02"}, {"until": "2024-01-02"}) == []


def test_full_last_page(spark, tmp_path):
    """Ranges whose last page is full, and one of a ticker without rows, as hours without a gap give them: all candles, no error."""
    page = [[1, 2, 3, 0.5, 10, 5, f"2024-01-01 {h:02d}:00:00", f"2024-01-01 {h:02d}:59:59"] for h in range(4)]
    body = lambda rows: json.dumps({"candles": {"columns": ["open", "close", "high", "low", "value", "volume", "begin", "end"], "data": rows}})
    at = f"file://{tmp_path}/pages"
    sinks.save_pages(spark.createDataFrame([("A", "2024-01-01", 0, body(page[:2])), ("A", "2024-01-01", 2, body(page[2:]))], "ticker string, begin string, start int, json string"), at)
    found = routes.fetch_candles(spark, at, ["A", "B"], "1H", "2024-01-01", "2024-01-02", range_days="1", page="2", mirror="yes")
    assert sorted((r["ticker"], r["begin"].hour) for r in found.collect()) == [("A", h) for h in range(4)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_in_any_zone(spark, zone):
    texts = ["2024-01-02T03:04:05Z", "2024-03-10T02:30:00", "2024-11-03 01:30:00", "2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z", "2024-01-02T03:04:05.125+03:00", "2024-01-02", " 2024-01-02 03:04 ", "2024-01-02T03:04:05.123456", "1965-01-02", "never"]
    want = ["2024-01-02T03:04:05", "2024-03-10T02:30:00", "2024-11-03T01:30:00", "2024-11-03T05:30:00", "2024-11-03T06:30:00", "2024-01-02T00:04:05.125", "2024-01-02", "2024-01-02T03:04:00", "2024-01-02T03:04:05.123456", "1965-01-02", None]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", flexible_time("t").alias("x")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r["x"] for r in rows] == [None if w is None else dt.datetime.fromisoformat(w) for w in want]

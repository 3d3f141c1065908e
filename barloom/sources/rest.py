"""A paged JSON source of candles and other resources, read by Spark as a data source, once or as a stream.

A partition is a ticker and a range of days, planned from the options; its pages are followed within it, on an executor. As a stream,
an offset is a time up to which candles are taken, so a range that is read again gives the same rows.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..functions.times import INTERVAL_CODES
from .blocks import BLOCK_COLUMNS

#: Rows of a full page, and names, paths and boards of the service's resources (here and in resource_path).
PAGE = 500
#: Days of a range, tries of a fetch, and seconds before the second try, doubled for each further one.
RANGE_DAYS, TRIES, PAUSE = 92, 3, 0.2
NAMED = ("tradestats", "orderstats", "obstats", "hi2")


def json_path(path: str) -> str:
    """A path under /iss/ that ends in .json, without a slash at its end; other endings, other places and a query in it are errors."""
    p = "/" + path.strip().lstrip("/").rstrip("/")
    if "?" in p:
        raise ValueError(f"query parameters are given apart from the path: {path}")
    if not p.startswith("/iss/") and p != "/iss":
        raise ValueError(f"not under /iss/: {path}")
    ending = re.search(r"\.(\w+)$", p)
    if ending and ending[1].lower() in ("xml", "csv", "html"):
        raise ValueError(f"only JSON is read: {path}")
    return p if ending and ending[1].lower() == "json" else p + ".json"


def resource_path(resource: str, ticker: str = "", dataset: str = "", market: str = "eq", board: str = "TQBR") -> str:
    at = f"/iss/engines/stock/markets/shares/boards/{board}/securities/{urllib.parse.quote(ticker, safe='')}"
    paths = {"candles": f"{at}/candles", "security": at, "orderbook": f"{at}/orderbook", "trades": f"{at}/trades", "sitenews": "/iss/sitenews", "futoi": f"/iss/analyticalproducts/futoi/securities/{ticker}"}
    if resource == "dataset":
        if not dataset:
            raise ValueError("dataset is needed")
        return json_path(f"/iss/datashop/algopack/{market or 'eq'}/{dataset}" + (f"/{ticker}" if ticker else ""))
    if resource in NAMED:
        return resource_path("dataset", ticker, resource, market, board)
    return json_path(paths[resource] if resource in paths else resource)


def headers(options: dict[str, str]) -> dict[str, str]:
    """A bearer token if there is one, else a user and password; a key and a cookie besides."""
    out = {"Accept": "application/json"}
    if options.get("token"):
        out["Authorization"] = f"Bearer {options['token']}"
    elif options.get("user"):
        out["Authorization"] = "Basic " + base64.b64encode(f"{options['user']}:{options.get('password', '')}".encode()).decode()
    if options.get("apikey"):
        out["X-Api-Key"] = options["apikey"]
    if options.get("cookie"):
        out["Cookie"] = options["cookie"]
    return out


def passing(error: Exception) -> bool:
    """Whether another try may do better: after an answer of 500 and above, a timeout or a failed connection."""
    return error.code >= 500 if isinstance(error, urllib.error.HTTPError) else isinstance(error, (urllib.error.URLError, TimeoutError, ConnectionError))


def fetched(url: str, options: dict[str, str], pause: Callable[[float], None] = time.sleep) -> bytes:
    """What an address gives, tried `tries` times with longer and longer pauses where the fault may pass."""
    request, tries = urllib.request.Request(url, headers=headers(options)), max(1, int(options.get("tries", TRIES)))
    for k in range(1, tries + 1):
        try:
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", 10))) as answer:
                return answer.read()
        except OSError as e:
            if k < tries and passing(e) and not url.startswith("file:"):
                pause(float(options.get("pause", PAUSE)) * 2 ** (k - 1))
                continue
            if isinstance(e, urllib.error.HTTPError):
                raise RuntimeError(f"{e.code} from {url}: {e.read(4096).decode('utf-8', 'replace')}") from e
            raise
    raise AssertionError


def mirrored(url: str) -> str:
    """The page that `save_pages` keeps in a folder; one that is not there, as after a last page that is full, has all columns and no rows."""
    parts = sorted(Path(urllib.request.url2pathname(urllib.parse.urlparse(url).path)).glob("part-*"))
    return parts[0].read_text(encoding="utf-8").rstrip("\n") if parts else json.dumps({"candles": {"columns": BLOCK_COLUMNS, "data": []}})


def fetch(url: str, options: dict[str, str]) -> str:
    """The body of a page; errors carry up to 4 KiB of what came instead. file: addresses serve tests and mirrors."""
    body = mirrored(url) if "mirror" in options else fetched(url, options).decode("utf-8")
    try:
        json.loads(body)
    except ValueError as e:
        page = "a web page" if body.lstrip().startswith("<") else "no JSON"
        raise RuntimeError(f"{url} gave {page}: {body[:200]}") from e
    return body


def pages(get: Callable[[int], str], size: int, most: int | None, block: str = "candles") -> Iterator[str]:
    """Pages from start on until one is short."""
    start = number = 0
    while most is None or number < most:
        body = get(start)
        yield body
        n = len((json.loads(body).get(block) or {}).get("data") or [])
        if n < size:
            return
        start += size
        number += 1


class RangePartition(InputPartition):
    """A ticker and the first and last day of a range, blank where there is none; of a stream, also the times from and before which
    candles are taken.
    """

    def __init__(self, ticker: str, begin: str = "", end: str = "", after: str = "", until: str = "") -> None:
        super().__init__((ticker, begin, end))
        self.ticker, self.begin, self.end, self.after, self.until = ticker, begin, end, after, until


def day_ranges(begin: str, end: str, days: int) -> list[tuple[str, str]]:
    """First and last days of ranges of so many days from begin to end, both included; they do not overlap."""
    first, last = dt.date.fromisoformat(begin[:10]), dt.date.fromisoformat(end[:10])
    out = []
    while first <= last:
        out.append((first.isoformat(), min(last, first + dt.timedelta(days - 1)).isoformat()))
        first += dt.timedelta(days)
    return out


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def tickers(self) -> list[str]:
        return [t.strip() for t in self.options.get("tickers", "").split(",")]

    def partitions(self) -> list[RangePartition]:
        """One for each ticker and range where both days are known and the resource has pages, else one for each ticker."""
        o = self.options
        begin, end = o.get("from", ""), o.get("till", "")
        cut = o.get("resource", "candles") == "candles" and begin and end and ("range_days" in o or not o["url"].startswith("file:"))
        ranges = day_ranges(begin, end, int(o.get("range_days", RANGE_DAYS))) if cut else [(begin[:10], end[:10])]
        return [RangePartition(t, a, b) for t in self.tickers() for a, b in ranges]

    def url(self, ticker: str, start: int, begin: str | None = None, end: str | None = None) -> str:
        o = self.options
        begin, end = o.get("from", "") if begin is None else begin, o.get("till", "") if end is None else end
        resource = o.get("resource", "candles")
        query = {k: o[k] for k in ("limit", "depth") if k in o}
        if resource == "candles":
            code = INTERVAL_CODES.get(o.get("timeframe", "1H").strip().upper())
            if code is None:
                raise ValueError(f"no interval for {o.get('timeframe')}")
            query |= {"interval": code, "from": begin[:10], "till": end[:10]}
        if start:
            query["start"] = start
        base = o["url"].rstrip("/")
        if "mirror" in o:
            return f"{base}/ticker={urllib.parse.quote(ticker, safe='')}/from={begin[:10]}/start={start}"
        if base.startswith("file:"):
            return f"{base}/{ticker}_{start}.json"
        return base + resource_path(resource, ticker, o.get("dataset", ""), o.get("market", "eq")) + "?" + urllib.parse.urlencode({k: v for k, v in query.items() if v != ""})

    def read(self, partition: RangePartition) -> Iterator[tuple]:
        size = int(self.options.get("page", PAGE))
        paged = self.options.get("resource", "candles") == "candles"
        most = int(self.options["pages"]) if "pages" in self.options else (None if paged else 1)
        get = lambda start: fetch(self.url(partition.ticker, start, partition.begin, partition.end), self.options)
        for number, body in enumerate(pages(get, size, most)):
            yield (partition.ticker, number, body)


def rows_in(body: str, block: str = "candles") -> int:
    return len((json.loads(body).get(block) or {}).get("data") or [])


class PollingReader(SimpleDataSourceStreamReader):
    """The source polled again and again: each ticker's offset is the number of rows taken from it so far. A batch takes whole pages
    from there on until one is short; a range of offsets that is read again gives the same pages while the source keeps its rows.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.reader = PagedReader(options)

    def initialOffset(self) -> dict:
        return {p.ticker: 0 for p in self.reader.partitions()}

    def take(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        rows, reached, o = [], {}, self.reader.options
        size = int(o.get("page", PAGE))
        for ticker, at in start.items():
            until = None if end is None else end[ticker]
            while until is None or at < until:
                body = fetch(self.reader.url(ticker, at), o)
                n = rows_in(body)
                if n:
                    rows.append((ticker, at, body))
                at += n
                if n < size:
                    break
            reached[ticker] = at
        return rows, reached

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self.take(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.take(start, end)[0])


def between(body: str, after: str, until: str, block: str = "candles") -> str | None:
    """A page with the candles alone that begin at after or later and before until; None where there is none."""
    page = json.loads(body)
    columns, data = page[block]["columns"], page[block]["data"]
    if not data:
        return None
    at = columns.index("begin")
    page[block]["data"] = [r for r in data if after <= r[at].replace("T", " ")[:19] < until]
    return json.dumps(page) if page[block]["data"] else None


class RangeStreamReader(DataSourceStreamReader):
    """The source as a stream of closed candles. An offset is a time: a batch has the candles that begin between two of them, from
    ranges of days that the executors fetch, so it is the same when it is read again after a failure, while the source keeps its candles.

    The time comes from the clock, `lag` minutes back, or is the content of the file that the option clock names.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.reader = options, PagedReader(options)

    def first(self) -> str:
        return self.options["from"].replace("T", " ")[:19]

    def initialOffset(self) -> dict:
        return {"until": self.first()}

    def latestOffset(self) -> dict:
        if "clock" in self.options:
            now = Path(urllib.request.url2pathname(urllib.parse.urlparse(self.options["clock"]).path)).read_text().strip()
        else:
            now = (dt.datetime.now(dt.UTC) - dt.timedelta(minutes=float(self.options.get("lag", 60)))).strftime("%Y-%m-%d %H:%M:%S")
        return {"until": max(self.first(), now.replace("T", " ")[:19])}

    def partitions(self, start: dict, end: dict) -> list[RangePartition]:
        """Ranges are counted from the option `from` on, so that they begin on the same days in each batch."""
        after, until = start["until"], end["until"]
        if after >= until:
            return []
        ranges = day_ranges(self.first(), until, int(self.options.get("range_days", RANGE_DAYS)))
        return [RangePartition(t, a, b, after, until) for t in self.reader.tickers() for a, b in ranges if b >= after[:10]]

    def read(self, partition: RangePartition) -> Iterator[tuple]:
        for ticker, number, body in self.reader.read(partition):
            if (kept := between(body, partition.after, partition.until)) is not None:
                yield (ticker, number, kept)


class PagedSource(DataSource):
    """spark.read.format("paged_json").option("url", ...).option("tickers", "A,B"): (ticker, page, json) rows, pages numbered within
    their range; decode_blocks makes candles of them. Options: resource, dataset, market, timeframe, from, till, range_days, depth,
    limit, pages, page, timeout, tries, pause, token, user, password, apikey, cookie; mirror for folders of `save_pages`; clock and lag for
    streams.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "ticker string, page int, json string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema: StructType) -> RangeStreamReader:
        """For spark.readStream of candles from a day on."""
        if not self.options.get("from") or self.options.get("resource", "candles") != "candles":
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader without a first day"})
        return RangeStreamReader(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> PollingReader:
        """For spark.readStream without a first day: page is then the number of its first row. Pages are fetched by the driver."""
        return PollingReader(dict(self.options))

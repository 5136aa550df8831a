"""A Python data source for paginated bar services; tickers are dealt to ``parallel`` partitions.

The transport is a function (url, params) -> (status, JSON), named by
``module:function``, so tests and other services bring their own; a file-backed one
is here. Reading follows ``next_url`` to the end, backs off on 429 and 5xx (each wait half as long again, ``max_backoff``
at most), drops symbols that the service calls invalid, and keeps the library's own ticker. ``always`` is a JSON object of parameters
that go with every page (a key, say). ``per_minute`` caps the calls of all partitions together: each takes its share.

A ticker's bars are given once its last page is there, all or none. An error ends the read, or with ``errors`` set to ``rows`` only
its ticker: the columns status (done, not_found, invalid, error) and error follow, with a row without a time for each ticker that has no bars or failed,
which is what the backfill ledger needs.

With ``batch`` set, one request asks for so many tickers (parameter ``symbols``, answer ``bars`` by symbol, ``next_page_token`` to go on). A symbol
that an error names is taken out and the rest is asked for again; a refused batch whose error names none is cut in halves until
the refused symbols stand alone.

Long lists of names do not go through the driver: ``write_names`` puts them into files, one for each partition, and the option ``names_at`` (for
``tickers`` or ``ids``) has the tasks read their own file, name after name. Its folder must be mounted by the driver and all executors.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from itertools import batched

import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions.text import CLASS_SHARE, INVALID_SYMBOL

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class TickerPartition(InputPartition):
    """Names, or the file that holds them."""

    def __init__(self, tickers: list[str] | str):
        super().__init__(tickers)


def write_names(names: DataFrame, path: str, partitions: int, order: str | None = None) -> str:
    """The first column of ``names`` (text) for ``names_at``: a file for each of ``partitions`` ranges of ``order`` (by default of the names), in order."""
    name = names.columns[0]
    by = order or name
    names.repartitionByRange(partitions, by).sortWithinPartitions(by).select(name).write.parquet(path)
    return path


class NamesReader(DataSourceReader):
    """A reader of names that an option lists or files hold; its partitions are made once."""

    def __init__(self, options: dict[str, str], listed: str):
        self.options = {k: v for k, v in options.items() if k != listed}
        if "names_at" in options:
            store, path = FileSystem.from_uri(options["names_at"])
            dealt = sorted(f.path for f in store.get_file_info(FileSelector(path)) if f.path.endswith(".parquet"))
        else:
            dealt = self.deal([n for n in options[listed].split(",") if n])
        self.dealt = [TickerPartition(d) for d in dealt] or [TickerPartition([])]
        self.pause = 60 * len(self.dealt) / float(options.get("per_minute", "inf"))

    def deal(self, names: list[str]) -> list[list[str]]:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        return self.dealt

    def names(self, partition: InputPartition) -> Iterator[str]:
        if not isinstance(partition.value, str):
            yield from partition.value
            return
        store, _ = FileSystem.from_uri(self.options["names_at"])
        with store.open_input_file(partition.value) as f:
            for rows in pq.ParquetFile(f).iter_batches():
                yield from rows.column(0).to_pylist()


def provider_symbol(ticker: str) -> str:
    return re.sub(CLASS_SHARE, r"\1.\2", ticker)


def invalid_symbol(message: str) -> str | None:
    found = re.search(INVALID_SYMBOL, message)
    return found[1] if found else None


class BarReader(NamesReader):
    def __init__(self, options: dict[str, str]):
        self.batch, self.parallel = int(options.get("batch", "0")), int(options.get("parallel", "8"))
        self.always = json.loads(options.get("always", "{}"))
        super().__init__(options, "tickers")

    def deal(self, names: list[str]) -> list[list[str]]:
        """To ``parallel`` partitions; whole batches, so that no request is split."""
        groups = [names[i : i + (self.batch or 1)] for i in range(0, len(names), self.batch or 1)]
        n = min(len(groups), self.parallel)
        return [[t for g in groups[i::n] for t in g] for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = self.options.get("errors") == "rows"
        module, _, name = self.options["transport"].partition(":")
        get = getattr(importlib.import_module(module), name)
        for group in map(list, batched(self.names(partition), self.batch or 1)):
            for ticker, bars, status, error in self._batch(get, group) if self.batch else self._single(get, group[0]):
                if status == "error" and not rows:
                    raise RuntimeError(f"{ticker}: {error}")
                for bar in bars:
                    yield (ticker, *bar, status, error) if rows else (ticker, *bar)
                if rows and not bars:
                    yield ticker, *[None] * 6, status, error

    def _get(self, get, url: str, params: dict) -> tuple[int, dict]:
        return _answer(get, url, params | self.always, self.pause, int(self.options.get("retries", "5")), float(self.options.get("backoff", "15")), float(self.options.get("max_backoff", "60")))

    def _single(self, get, ticker: str) -> Iterator[tuple]:
        """(ticker, bars, status, error) of one ticker: all its pages, or why not."""
        url, params, bars = self.options["base"].rstrip("/") + "/" + provider_symbol(ticker), dict(adjusted="true", sort="asc"), []
        try:
            while url:
                status, data = self._get(get, url, params)
                if status == 404 or status == 400 and invalid_symbol(json.dumps(data)):
                    yield ticker, [], "not_found" if status == 404 else "invalid", None
                    return
                if status >= 400:
                    raise RuntimeError(f"{status} for {url}")
                bars += map(_bar, data.get("results") or [])
                url, params = data.get("next_url"), {}
        except Exception as e:
            yield ticker, [], "error", str(e)
            return
        yield ticker, bars, "done" if bars else "not_found", None

    def _batch(self, get, tickers: list[str]) -> Iterator[tuple]:
        """The same of many tickers in one request."""
        names = {provider_symbol(t): t for t in tickers}
        while names:
            found: dict[str, list] = {n: [] for n in names}
            params: dict = {"symbols": ",".join(names)}
            try:
                while True:
                    status, data = self._get(get, self.options["base"], params)
                    if status >= 400:
                        break
                    for symbol, bars in (data.get("bars") or {}).items():
                        found[symbol] += map(_bar, bars)
                    if not data.get("next_page_token"):
                        break
                    params = params | {"page_token": data["next_page_token"]}
            except Exception as e:
                status, data = 599, {"message": str(e)}
            if status < 400:
                for symbol, bars in found.items():
                    yield names[symbol], bars, "done" if bars else "not_found", None
                return
            text = json.dumps(data)
            bad = invalid_symbol(text)
            if bad in names:
                yield names.pop(bad), [], "invalid", text
            elif status in (400, 422) and len(names) > 1:  # refused without a name
                half = [names[n] for n in list(names)[: len(names) // 2]]
                yield from self._batch(get, half)
                names = {n: t for n, t in names.items() if t not in half}
            else:
                refused = "invalid" if status in (400, 422) else "error"
                for ticker in names.values():
                    yield ticker, [], refused, text
                return


def _bar(r: dict) -> tuple:
    return EPOCH + timedelta(milliseconds=r["t"]), *(float(r[k]) if r.get(k) is not None else None for k in "ohlcv")


def _answer(get, url: str, params: dict, pause: float, retries: int, backoff: float, most: float, growth: float = 1.5) -> tuple[int, dict]:
    """One page, asked for again while the service is busy; each wait is ``growth`` times the one before."""
    for attempt in range(retries):
        time.sleep(pause)
        status, body = get(url, params)
        if status != 429 and status < 500:
            return status, body
        time.sleep(min(most, backoff * growth**attempt))
    raise RuntimeError(f"no answer for {url} after {retries} attempts")


class BarSource(DataSource):
    """``spark.read.format("rest_bars")`` with options tickers, base, transport."""

    @classmethod
    def name(cls) -> str:
        return "rest_bars"

    def schema(self) -> str:
        bar = "ticker string, datetime timestamp, open double, high double, low double, close double, volume double"
        return bar + ", status string, error string" if self.options.get("errors") == "rows" else bar

    def reader(self, schema) -> DataSourceReader:
        return BarReader(dict(self.options))


class PageReader(NamesReader):
    def __init__(self, options: dict[str, str]):
        self.size = int(options.get("per_page", "250"))
        super().__init__(options, "ids")

    def deal(self, names: list[str]) -> list[list[str]]:
        return [names[i : i + self.size] for i in range(0, len(names), self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        get, key = getattr(importlib.import_module(module), name), self.options.get("key", "id")
        for group in batched(self.names(partition), self.size):
            params = {"ids": ",".join(group)} | json.loads(self.options.get("always", "{}"))
            try:
                status, data = _answer(get, self.options["base"], params, self.pause, int(self.options.get("retries", "4")), float(self.options.get("backoff", "0.5")), float(self.options.get("max_backoff", "60")), 2.0)
                found = {str(r.get(key)): r for r in data} if status < 400 else {}
                error = None if status < 400 else f"{status}"
            except Exception as e:
                found, error = {}, str(e)
            if error is not None and self.options.get("errors") == "raise":
                raise RuntimeError(f"{group[0]} to {group[-1]}: {error}")
            for i in group:
                yield i, json.dumps(found[i]) if i in found else None, error


class PageSource(DataSource):
    """``spark.read.format("rest_pages")``: objects by id, ``per_page`` ids to a request (options ids, base, transport, key); a task makes one request, or those of its file of names. Rows (id, raw, error): raw is null for an id that the service does not know,
    and for those of a request that failed, whose error says why. With ``errors`` set to ``raise`` a failed request ends the read instead; what does not keep ``error`` needs this."""

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "id string, raw string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


def file_transport(url: str, params: dict) -> tuple[int, dict]:
    """Pages from JSON files: ``url`` is a path without its ending."""
    try:
        with open(f"{url}.json") as f:
            return 200, json.load(f)
    except FileNotFoundError:
        return 404, {}

"""A Python Data Source of provider charts: one partition for each asset and window, with bounded retries inside the reader.

    spark.dataSource.register(ChartSource)
    spark.read.format("provider_chart").options(assets="A,B", first="2024-01-01", last="2024-12-31", window_days="90", transport="package.module:function").load()

Rows: asset, first, last, status (ok or failed), http_status, attempts, waited (seconds), body, error. A failed window is a row, not an
exception, so the others are read and the caller decides; ``chart_bars`` takes the bodies of those that are ok.

The transport is a function (asset, first, last, attempt, options) that returns (http status, body) or raises OSError; ``http_get`` opens
the option ``url`` with the asset and the window filled in, ``replay`` reads recorded answers from the folder of the option ``folder``.
Answers of 429 and 500 to 599 and OSErrors are tried again, ``max_attempts`` times in all, after ``backoff_seconds`` doubled each time; any
other answer than 200 fails at once. A task that is run again asks again.
"""

from __future__ import annotations

import importlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "asset string, first date, last date, status string, http_status int, attempts int, waited double, body string, error string"


def http_get(asset: str, first: date, last: date, attempt: int, options: dict) -> tuple[int, str]:
    url = options["url"].format(asset=asset, first=first.isoformat(), last=last.isoformat())
    try:
        with urllib.request.urlopen(url, timeout=float(options.get("timeout", 10))) as answer:
            return answer.status, answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, ""


def replay(asset: str, first: date, last: date, attempt: int, options: dict) -> tuple[int, str]:
    """The recorded answer ``<asset>.json``: a list of [status, body] by attempt, the last of which holds from then on; null stands for a lost connection."""
    with open(os.path.join(options["folder"], f"{asset}.json"), encoding="utf-8") as f:
        answers = json.load(f)
    answer = answers[min(attempt, len(answers)) - 1]
    if answer is None:
        raise OSError("connection lost")
    return answer[0], answer[1] if isinstance(answer[1], str) else json.dumps(answer[1])


def windows(first: date, last: date, days: int) -> list[tuple[date, date]]:
    """Inclusive windows of at most ``days`` days that cover first to last."""
    if first > last or days < 1:
        raise ValueError("first must not be after last, and a window has one day at least")
    starts = [first + timedelta(days=k) for k in range(0, (last - first).days + 1, days)]
    return [(s, min(last, s + timedelta(days=days - 1))) for s in starts]


class Window(InputPartition):
    def __init__(self, asset: str, first: date, last: date):
        self.asset, self.first, self.last = asset, first, last


class ChartReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.assets = [a.strip() for a in self.options.get("assets", "").split(",") if a.strip()]
        self.attempts, self.backoff = int(self.options.get("max_attempts", 3)), float(self.options.get("backoff_seconds", 1))
        if not self.assets or len(set(self.assets)) != len(self.assets):
            raise ValueError("assets must be a comma-separated list of different names")
        if self.attempts < 1 or self.backoff < 0:
            raise ValueError("max_attempts must be at least one and backoff_seconds not negative")

    def partitions(self) -> list[Window]:
        first, last = (date.fromisoformat(self.options[k]) for k in ("first", "last"))
        spans = windows(first, last, int(self.options.get("window_days", (last - first).days + 1)))
        return [Window(a, *s) for a in self.assets for s in spans]

    def read(self, partition: Window) -> Iterator[tuple]:
        module, _, name = self.options.get("transport", f"{__name__}:http_get").partition(":")
        ask = getattr(importlib.import_module(module), name)
        status, error, body, waited, attempt = None, None, None, 0.0, 0
        while attempt < self.attempts:
            if attempt:
                pause = self.backoff * 2 ** (attempt - 1)
                time.sleep(pause)
                waited += pause
            attempt += 1
            try:
                (status, body), error = ask(partition.asset, partition.first, partition.last, attempt, self.options), None
            except OSError as e:
                status, error = None, str(e)
                continue
            if status == 200:
                break
            error = f"http status {status}"
            if status != 429 and not 500 <= status < 600:
                break
        good = status == 200
        yield partition.asset, partition.first, partition.last, "ok" if good else "failed", status, attempt, waited, body if good else None, error


class ChartSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_chart"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChartReader:
        return ChartReader(self.options)

"""A data source over paged services: one partition per page, read by offset and length."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class PagedSource(DataSource):
    """``spark.read.format("paged").option("url", "...?offset={offset}&length={length}")``: rows as ``row_idx, row``.

    A page is ``{"total": n, "rows": [...]}``. ``length`` rows make a page; ``attempts`` and ``backoff`` (seconds,
    doubled each time) bound the retries of each page on its own.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "row_idx long, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.length = options["url"], int(options.get("length", 100))
        self.attempts, self.backoff = int(options.get("attempts", 3)), float(options.get("backoff", 0.5))

    def fetch(self, offset: int, length: int) -> dict:
        for attempt in range(self.attempts):
            try:
                with urlopen(self.url.format(offset=offset, length=length)) as reply:
                    return json.load(reply)
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.backoff * 2**attempt)
        raise OSError("no attempt allowed")

    def partitions(self) -> list[Page]:
        total = self.fetch(0, 1)["total"]
        return [Page(at, min(self.length, total - at)) for at in range(0, total, self.length)] or [Page(0, 0)]

    def read(self, page: Page) -> Iterator[tuple]:
        if page.length:
            for i, row in enumerate(self.fetch(page.offset, page.length)["rows"]):
                yield page.offset + i, json.dumps(row, sort_keys=True)

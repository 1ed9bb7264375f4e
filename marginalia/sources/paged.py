"""Paged remote collections as a Spark data source.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("fetcher", "package.module:function").option("total", 5000).load()

The fetcher is called with (start, limit), and with the option ``path`` if there is one, and returns a list of JSON objects with a ``key``. With a known
total every page is a partition of its own and pages are fetched in parallel; without it one task reads
until a page is empty or short, or ``max_records`` are read.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, start: int, limit: int, to_end: bool):
        self.start, self.limit, self.to_end = start, limit, to_end


def load_fetcher(name: str) -> Callable[[int, int], list]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetcher = options["fetcher"]
        self.path = options.get("path")
        self.size = int(options.get("page_size", 100))
        self.total = int(options["total"]) if "total" in options else None
        self.most = int(options["max_records"]) if "max_records" in options else None

    def partitions(self) -> list[Page]:
        if self.total is None:
            return [Page(0, self.size, True)]
        end = self.total if self.most is None else min(self.total, self.most)
        return [Page(k, min(self.size, end - k), False) for k in range(0, end, self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        fetch, start, read = load_fetcher(self.fetcher), partition.start, 0
        while True:
            limit = partition.limit if self.most is None or not partition.to_end else min(partition.limit, self.most - read)
            page = (fetch(start, limit, self.path) if self.path else fetch(start, limit)) if limit > 0 else []
            if not isinstance(page, list):
                return
            for record in page:
                yield str(record.get("key", "")), int(record.get("version") or 0), json.dumps(record, ensure_ascii=False)
            read += len(page)
            if not partition.to_end or len(page) < limit or not page:
                return
            start += len(page)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "key string, version int, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

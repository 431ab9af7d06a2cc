"""A paged list source as a Python data source: one page is one partition; pages come from files, newest first."""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def expected_rows(page: int, page_size: int, total: int) -> int:
    """How many rows a page must hold: the last one may be short."""
    return min(page_size, max(total - (page - 1) * page_size, 0))


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.names = [f.name for f in schema.fields]
        self.path, self.size = options["path"], int(options.get("page_size", 100))
        if not 1 <= self.size <= 100:
            raise ValueError("page_size is a number from 1 to 100")

    def _page(self, number: int) -> dict:
        with open(os.path.join(self.path, f"page-{number}.json"), encoding="utf-8-sig") as f:
            return json.load(f)["data"]

    def partitions(self):
        total = int(self._page(1)["recordsFiltered"])
        return [Page(n) for n in range(1, max(1, -(-total // self.size)) + 1)]

    def read(self, partition):
        page = self._page(partition.number)
        rows = page["data"]
        wanted = expected_rows(partition.number, self.size, int(page["recordsFiltered"]))
        if len(rows) != wanted:
            raise ValueError(f"page {partition.number} has {len(rows)} rows instead of {wanted}")
        for r in rows:
            yield tuple(None if r.get(n) is None else str(r[n]) for n in self.names)


class PagedSource(DataSource):
    """``spark.read.format("corpus_pages").option("page_size", n).load(folder)``; all columns are text."""

    @classmethod
    def name(cls):
        return "corpus_pages"

    def schema(self):
        return "id string, daire string, esasNo string, kararNo string, kararTarihi string"

    def reader(self, schema):
        return PagedReader(schema, self.options)

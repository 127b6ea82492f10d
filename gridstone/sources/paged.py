"""Paged sources: a Spark data source that reads the total first and then every page in a task of its own."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int, total: int):
        super().__init__(offset)
        self.offset, self.total = offset, total


class PagedReader(DataSourceReader):
    """Reads pages of `limit` rows at growing offsets until the total that the first page names; fetch() may be another transport."""

    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.kinds = [f.dataType.simpleString() for f in schema.fields]
        self.path, self.limit = options["path"], int(options.get("limit", 100))
        self.retries, self.pause = int(options.get("retries", 3)), float(options.get("pause", 0.1))

    def fetch(self, offset: int) -> dict:
        """{"total": n, "rows": [...]} of a page: the lines of the files under `offset=...` in the folder, the total in each line."""
        files, home = fs.FileSystem.from_uri(self.path)
        found = sorted(f.path for f in files.get_file_info(fs.FileSelector(f"{home}/offset={offset}")) if f.is_file and not f.base_name.startswith(("_", ".")))
        if not found:
            raise FileNotFoundError(f"page {offset} of {self.path}")
        rows, total = [], 0
        for at in found:
            with files.open_input_stream(at) as stream:
                for line in stream.read().decode().splitlines():
                    page = json.loads(line)
                    total, rows = max(total, page["total"]), rows + page["rows"]
        return {"total": total, "rows": rows}

    def _page(self, offset: int) -> dict:
        for attempt in range(self.retries + 1):
            try:
                return self.fetch(offset)
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def partitions(self) -> list[Page]:
        total = self._page(0)["total"]
        return [Page(offset, total) for offset in range(0, max(total, 1), self.limit)]

    def read(self, partition: Page) -> Iterator[tuple]:
        page = self._page(partition.offset)
        wanted = min(self.limit, partition.total - partition.offset)
        if page["total"] != partition.total or len(page["rows"]) != wanted:  # a page that came short or a source that moved would lose or repeat rows
            raise ValueError(f"page {partition.offset} of {self.path} has {len(page['rows'])} rows of {wanted}, total {page['total']} of {partition.total}")
        for row in page["rows"]:
            yield tuple(None if row.get(n) is None else float(row[n]) if k == "double" else row[n] for n, k in zip(self.names, self.kinds))


class PagedSource(DataSource):
    """spark.read.format("paged").schema(...).option("path", ...).option("limit", 100).load(); register it once a session."""

    reader_type = PagedReader

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self):
        raise ValueError("name the schema of a paged source")

    def reader(self, schema) -> PagedReader:
        return self.reader_type(schema, self.options)

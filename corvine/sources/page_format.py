"""Files of pages as a Spark source: ``spark.read.format("corvine_pages")``, and ``readStream`` over files that arrive.

Options: ``path``, a folder or a file, by any address that Arrow's file systems know; ``share``, bytes of a file that make a
partition; ``reader``, ``module:name`` of an object with ``count(content)`` and ``page(content, i)`` for other kinds of files.
By itself the source reads text with form feeds between pages.

A partition is a run of the pages of one file. How many pages a file has is told in the task that reads it, so the driver
lists files and sizes and opens none; only the pages of its own run are taken out of a file by a task. Filters on ``path`` and
``page`` are handed to the source: files that no row can come from have no partition, other pages are not taken out.

A stream's offset is a time and a path: files come in the order in which they were changed, and equal times by path. A file
that appears with an earlier time than the offset is not seen, so files have to be moved into place when they are complete.

Columns: path, page (from 1), n_pages, file_hash (SHA-256 of the file), text. An empty file has no page.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, page int, n_pages int, file_hash string, text string"
#: Bytes of a file that make a partition.
SHARE = 32 << 20
TESTS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b}


class FormFeeds:
    """Text with a form feed behind each page; the last one needs none."""

    def _pages(self, content: bytes) -> list[bytes]:
        pages = content.split(b"\f")
        return pages if pages[-1] else pages[:-1]

    def count(self, content: bytes) -> int:
        return len(self._pages(content))

    def page(self, content: bytes, i: int) -> str:
        return self._pages(content)[i].decode("utf-8", "replace")

    def between(self, content: bytes, first: int, last: int) -> Iterator[tuple[int, str]]:
        for i, x in enumerate(self._pages(content)[first:last]):
            yield first + i, x.decode("utf-8", "replace")


@dataclass
class Run(InputPartition):
    """The ``part``-th of ``parts`` equal runs of the pages of a file."""

    path: str
    part: int
    parts: int


def _fits(value, tests: list) -> bool:
    return all(TESTS[type(f)](value, f.value) for f in tests)


class _Files:
    """What both readers do: list files, and read one run of pages."""

    def __init__(self, options: dict):
        self.path, self.share, self.reader = options["path"], int(options.get("share", SHARE)), options.get("reader")
        self.on_path, self.on_page = [], []

    def listed(self) -> list[tuple[int, str, int]]:
        """(time in microseconds, address, size), in order. Hidden files and those with a leading underscore are left out."""
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        head = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        shown = lambda x: not any(part[:1] in "._" for part in x.path[len(at) :].split("/") if part)
        return sorted((x.mtime_ns // 1000, head + x.path, x.size) for x in found if x.type == fs.FileType.File and (x.path == at or shown(x)))

    def runs(self, files: list[tuple[int, str, int]]) -> list[Run]:
        files = [f for f in files if _fits(f[1], self.on_path)]
        return [Run(path, part, parts) for _, path, size in files for parts in (max(1, -(-size // self.share)),) for part in range(parts)]

    def read(self, run: Run) -> Iterator[tuple]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(run.path) if "://" in run.path or run.path.startswith("file:") else (fs.LocalFileSystem(), run.path)
        with system.open_input_stream(at) as f:
            content = f.read()
        provider = FormFeeds()
        if self.reader:
            module, _, name = self.reader.partition(":")
            provider = getattr(importlib.import_module(module), name)()
        n, digest = provider.count(content), hashlib.sha256(content).hexdigest()
        first, last = n * run.part // run.parts, n * (run.part + 1) // run.parts
        between = provider.between(content, first, last) if hasattr(provider, "between") else ((i, provider.page(content, i)) for i in range(first, last) if _fits(i + 1, self.on_page))
        for i, text in between:
            if _fits(i + 1, self.on_page):
                yield run.path, i + 1, n, digest, text


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and f.attribute == ("path",):
                self.files.on_path.append(f)
            elif type(f) in TESTS and f.attribute == ("page",):
                self.files.on_page.append(f)
            else:
                yield f

    def partitions(self):
        # a table without files still needs a partition
        return self.files.runs(self.files.listed()) or [Run("", 0, 0)]

    def read(self, partition):
        return self.files.read(partition) if partition.parts else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.files.listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        place = lambda x: (x["time"], x["path"])
        return self.files.runs([f for f in self.files.listed() if place(start) < f[:2] <= place(end)])

    def read(self, partition):
        return self.files.read(partition)


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corvine_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark) -> None:
    """Makes the format known to a session, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)

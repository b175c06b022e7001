"""Pages and sheet rows of files as Spark data sources: large files are read by several tasks, a range of units each.

    spark.dataSource.register(PageSource)
    spark.read.format("docmill_pages").option("parser", "package.module:parser").load("/shared/folder")

A parser is an object with ``count(file)``, the number of units of an open binary file, and ``units(file, first, end)``, which gives those
from first to end (from 0): a page is a list of texts, a row a list of cells. Files are opened through pyarrow's file systems, so the path
must be one that these and all executors reach; for files that only Spark's readers reach there is :func:`docmill.sources.readers.file_pages`.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Units that a task reads of a file, bytes from which a file is split, and bytes of smaller files that a task reads together.
PER_TASK, LARGE, TOGETHER = 64, 32 << 20, 64 << 20


@dataclass
class Range(InputPartition):
    """Units first to end of a file, or whole files (end is None)."""

    paths: tuple[str, ...]
    first: int = 0
    end: int | None = None


class RangeReader(DataSourceReader):
    """Deals files to tasks: small ones several together, large ones in ranges of units, for which only their count is asked beforehand."""

    def __init__(self, options: dict):
        if "path" not in options or "parser" not in options:
            raise ValueError("a path and the option parser (module:object) are needed")
        self.path, self.name = options["path"], options["parser"]
        self.per_task, self.large, self.together = (int(options.get(k.lower(), d)) for k, d in (("unitsPerTask", PER_TASK), ("largeBytes", LARGE), ("bytesTogether", TOGETHER)))

    @property
    def parser(self):
        module, _, name = self.name.partition(":")
        return getattr(importlib.import_module(module), name)

    def system(self):
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> Sequence[InputPartition]:
        system, path = self.system()
        info = system.get_file_info(path)
        found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file]
        out, held, size = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            if x.size >= self.large:
                with system.open_input_file(x.path) as f:
                    n = self.parser.count(f)
                out += [Range((x.path,), k, min(n, k + self.per_task)) for k in range(0, n, self.per_task)]
                continue
            if held and size + x.size > self.together:
                out.append(Range(tuple(held)))
                held, size = [], 0
            held.append(x.path)
            size += x.size
        return [*out, Range(tuple(held))]  # an empty range, where nothing is left

    def read(self, partition: Range) -> Iterator[tuple]:
        system, parser = self.system()[0], self.parser
        for path in partition.paths:
            with system.open_input_file(path) as f:
                end = parser.count(f) if partition.end is None else partition.end
                f.seek(0)
                for k, unit in enumerate(parser.units(f, partition.first, end), partition.first):
                    yield self.row(path, k, unit)

    def row(self, path: str, k: int, unit: list) -> tuple:
        raise NotImplementedError


class PageReader(RangeReader):
    def row(self, path, k, unit):
        return path, k + 1, " ".join(unit)


class SheetReader(RangeReader):
    def row(self, path, k, unit):
        return path, k, [None if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v) for v in unit]


class PageSource(DataSource):
    """Pages of files: path, page (from 1), text (its items, a blank between)."""

    @classmethod
    def name(cls) -> str:
        return "docmill_pages"

    def schema(self) -> str:
        return "path string, page int, text string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


class SheetSource(DataSource):
    """Rows of the first sheets of files: path, pos (from 0), cells; dates are ISO texts."""

    @classmethod
    def name(cls) -> str:
        return "docmill_sheets"

    def schema(self) -> str:
        return "path string, pos long, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(dict(self.options))

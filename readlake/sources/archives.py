"""Archives as a Spark data source that plans by entry.

An archive's directory says where each entry's bytes are, so a large archive is cut into tasks of neighbouring entries
and a task reads the byte ranges of its own alone; small archives share a task.  Nothing holds an archive whole.
Filters on path, entry and size reach the reader.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from readlake.sources.files import BROKEN, read_entry

SCHEMA = "path string, entry string, ord int, size long, flags int, method int, content binary, status string"
#: How filters on a column become tests of its value; what isn't here stays with Spark.
_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda f: lambda v: v == f.value, ds.In: lambda f: lambda v: v in f.value, ds.StringStartsWith: lambda f: lambda v: v.startswith(f.value), ds.StringEndsWith: lambda f: lambda v: v.endswith(f.value),
    ds.StringContains: lambda f: lambda v: f.value in v, ds.LessThan: lambda f: lambda v: v < f.value, ds.LessThanOrEqual: lambda f: lambda v: v <= f.value, ds.GreaterThan: lambda f: lambda v: v > f.value,
    ds.GreaterThanOrEqual: lambda f: lambda v: v >= f.value, ds.IsNotNull: lambda f: lambda v: True,
}


@dataclass
class Entries(ds.InputPartition):
    """Archives of one task, each with its entries from ``first`` up to ``last`` (None: all)."""

    parts: list[tuple[str, int, int | None]]


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.accept = options["path"], options.get("accept", "")
        self.max_entry, self.split = int(options.get("maxentry", 32 << 20)), int(options.get("splitbytes", 64 << 20))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("entry",), ("size",)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self) -> Callable[[str, str | None, int | None], bool]:
        tests = [(f.attribute[0], _TESTS[type(f)](f)) for f in self.filters]

        def wanted(path: str, entry: str | None, size: int | None) -> bool:
            row = {"path": path, "entry": entry, "size": size}
            return all(row[c] is not None and test(row[c]) for c, test in tests)

        return wanted

    def partitions(self) -> list[Entries]:
        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File), key=lambda f: f.path)
        out, held, size = [], [], 0
        for f in files:
            if f.size > self.split:
                out += [Entries([(f.path, a, b)]) for a, b in self._cuts(system, f.path)]
                continue
            if size + f.size > self.split and held:
                out.append(Entries(held))
                held, size = [], 0
            held.append((f.path, 0, None))
            size += f.size
        return [*out, Entries(held)] if held else out

    def _cuts(self, system: fs.FileSystem, path: str) -> Iterator[tuple[int, int | None]]:
        """Entry ranges of about ``split`` compressed bytes, from the directory alone."""
        try:
            with system.open_input_file(path) as data, zipfile.ZipFile(data) as z:
                entries = z.infolist()
        except BROKEN:
            yield 0, None
            return
        first = total = 0
        for k, i in enumerate(entries):
            total += i.compress_size
            if total > self.split and k > first:
                yield first, k
                first, total = k, i.compress_size
        yield first, None

    def read(self, partition: Entries | None) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        accepted, wanted = re.compile(self.accept), self._wanted()
        # without any file Spark still runs one task
        for path, first, last in partition.parts if partition else ():
            try:
                with system.open_input_file(path) as data, zipfile.ZipFile(data) as z:
                    for k, i in enumerate(z.infolist()[first:last], first):
                        if wanted(path, i.filename, i.file_size):
                            yield (path, i.filename, k, i.file_size, i.flag_bits, i.compress_type, *read_entry(z, i, accepted, self.max_entry))
            except BROKEN:
                if wanted(path, None, None):
                    yield path, None, None, None, None, None, None, "corrupt"


class ArchiveSource(ds.DataSource):
    """Format ``archive``: options path (a file or folder, any system of ``pyarrow.fs``), accept (a pattern that entry
    names must have to be read; others have headers alone), maxEntry and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, accept: str = "", max_entry: int = 32 << 20, split_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``scan_archive`` for the archives under a path, read entry by entry.  A file that is no archive is one
    ``corrupt`` row; an empty folder gives no rows.  Turns the session's filter push-down for Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("accept", accept).option("maxEntry", max_entry).option("splitBytes", split_bytes).load(path)

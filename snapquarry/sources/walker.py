"""File trees as a Spark data source: ``spark.read.format("filetree").option("path", ...)``.

Rows are stored paths below the name of the source, with what ``lstat`` tells.  Links are
not followed; sockets, devices and pipes are left out.  Each source is listed by one task,
directory by directory; times are nanoseconds.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path STRING, type STRING, mode BIGINT, uid BIGINT, gid BIGINT, size BIGINT, mtime BIGINT, symlink_target STRING, real_path STRING"


def describe(stored: str, real: str) -> tuple | None:
    """A row, or None for what isn't a file, directory or link."""
    s = os.lstat(real)
    if stat.S_ISLNK(s.st_mode):
        kind, target, size = "symlink", os.readlink(real), 0
    elif stat.S_ISDIR(s.st_mode):
        kind, target, size = "dir", "", 0
    elif stat.S_ISREG(s.st_mode):
        kind, target, size = "file", "", s.st_size
    else:
        return None
    return stored, kind, s.st_mode & 0o777, s.st_uid, s.st_gid, size, s.st_mtime_ns, target, real


def walk(source: str) -> Iterator[tuple]:
    source = os.path.abspath(source)
    waiting = [(os.path.basename(source) or "/", source)]
    while waiting:
        stored, real = waiting.pop()
        row = describe(stored, real)
        if row is None:
            continue
        yield row
        if row[1] == "dir":
            waiting += [(f"{stored}/{n}", os.path.join(real, n)) for n in sorted(os.listdir(real), reverse=True)]


class _Reader(DataSourceReader):
    def __init__(self, sources: list[str]):
        self.sources = sources

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.sources]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from walk(partition.value)


class FileTree(DataSource):
    """``path``: one source, or ``paths``: a JSON list of them."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]])

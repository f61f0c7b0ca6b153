"""A folder of documents as a data source of Spark: planned by bytes, guarded by size before anything is read, and as a stream of new files.

    spark.dataSource.register(DocumentFolder)
    spark.read.format("document_folder").option("max_bytes", 20_000_000).load("file:///documents")

Columns: path, length, modification time, content (null where a file is larger than max_bytes). Folders are on any file
system that pyarrow opens by its address.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


@dataclass
class Files(InputPartition):
    """Files that one task reads: path, length, nanoseconds of the last change."""

    files: tuple[tuple[str, int, int], ...]


class _Folder:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        self.suffixes = tuple(x for x in options.get("suffixes", "").lower().split(",") if x)
        self.most, self.share = int(options.get("max_bytes", 20 * 1024 * 1024)), int(options.get("partition_bytes", 128 << 20))
        self.recursive = options.get("recursive", "true").lower() == "true"
        if not self.path or self.most < 0 or self.share <= 0:
            raise ValueError("document_folder needs a path, and sizes that aren't negative")

    def _opened(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def listed(self) -> list[tuple[str, int, int]]:
        """Files in order of their paths; hidden ones aren't seen."""
        from pyarrow import fs

        where, root = self._opened()
        found = where.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        inside = lambda p: not any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
        return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and inside(f.path) and (not self.suffixes or f.path.lower().endswith(self.suffixes)))

    def planned(self, files: list[tuple[str, int, int]]) -> list[Files]:
        """Neighbours together, up to so many bytes that are read; files that are too large cost nothing."""
        out, held, size = [], [], 0
        for f in files:
            cost = (f[1] if f[1] <= self.most else 0) + 4096  # opening one costs something, too
            if held and size + cost > self.share:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f)
            size += cost
        return [*out, Files(tuple(held))] if held else out

    def read(self, partition: Files) -> Iterator[tuple]:
        from datetime import UTC, datetime

        where, _ = self._opened()
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file:"
        for path, length, at in partition.files:
            content = None
            if length <= self.most:
                with where.open_input_stream(path) as f:
                    content = f.read()
            yield f"{scheme}{path}", datetime.fromtimestamp(at / 1e9, UTC), length, content


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def partitions(self) -> list[Files]:
        return self.folder.planned(self.folder.listed()) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time of the newest file seen and the names of those of that very time: they stay small however many files there are."""

    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"at": -1, "names": "[]"}

    def latestOffset(self) -> dict:
        files = self.folder.listed()
        at = max((f[2] for f in files), default=-1)
        return {"at": at, "names": json.dumps([f[0] for f in files if f[2] == at])}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        seen, last = set(json.loads(start["names"])), set(json.loads(end["names"]))
        new = [f for f in self.folder.listed() if start["at"] <= f[2] <= end["at"] and not (f[2] == start["at"] and f[0] in seen) and (f[2] < end["at"] or f[0] in last)]
        return self.folder.planned(new) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


class DocumentFolder(DataSource):
    """Options: path, suffixes (with commas between), max_bytes, partition_bytes, recursive.

    As a stream it gives each file once, when it is first seen; files must come with a time of change no older than the newest
    one before them, as files that are written (not moved) into a folder do.
    """

    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(_Folder(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _StreamReader(_Folder(self.options))

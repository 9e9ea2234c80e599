"""A stream of files that are new or have changed, told by time and path alone.

``spark.readStream.format("changed_files")`` gives path, length and modified of files below a folder. The offset is the
(modified, path) of the last file given, so a file comes again each time it's written again, whether it grew, shrank or kept its
length; a tick lists the folder and opens no file. Spark's own file source gives a path once and never again.

Times must only grow: a file that is put there with an older time than one already given isn't seen, which a full comparison
(``plans.ingest.ingest``) does see. A file written again before a batch is read comes with its newest state and once more after
that, so what consumes it should be idempotent. Folders can be local or in any store that Arrow opens.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .records import opened

#: Files of a partition of a batch.
FILES = 10_000
BEGIN = {"modified": -1, "path": ""}


@dataclass
class Listed(InputPartition):
    files: list[tuple[str, int, int]]


class ChangeReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str | None):
        self.path, self.pattern = path, pattern

    def _files(self) -> list[tuple[int, str, int]]:
        """(modified in nanoseconds, path, length) of all files that aren't hidden, in order."""
        from pyarrow import fs

        store, root = opened(self.path)
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else "file://"
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(root) :].split("/"))
        return sorted((f.mtime_ns, f"{scheme}{f.path}", f.size) for f in found if f.is_file and not hidden(f.path) and (not self.pattern or fnmatch.fnmatch(f.base_name, self.pattern)))

    def initialOffset(self) -> dict:
        return dict(BEGIN)

    def latestOffset(self) -> dict:
        files = self._files()
        return {"modified": files[-1][0], "path": files[-1][1]} if files else dict(BEGIN)

    def partitions(self, start: dict, end: dict) -> list[Listed]:
        low, high = (start["modified"], start["path"]), (end["modified"], end["path"])
        some = [(path, size, at) for at, path, size in self._files() if low < (at, path) <= high]
        return [Listed(some[i : i + FILES]) for i in range(0, len(some), FILES)]

    def read(self, partition: Listed) -> Iterator[tuple]:
        for path, size, at in partition.files:
            yield path, size, datetime.fromtimestamp(at // 1000 / 1e6, timezone.utc)


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return "path string, length bigint, modified timestamp"

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(self.options["path"].rstrip("/"), self.options.get("pattern"))


def changed_files(spark: SparkSession, path: str, pattern: str | None = None):
    """The stream of a folder's new and changed files."""
    spark.dataSource.register(ChangedFiles)
    reader = spark.readStream.format("changed_files").option("path", path)
    return (reader.option("pattern", pattern) if pattern else reader).load()

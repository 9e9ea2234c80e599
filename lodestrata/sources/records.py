"""A data source that writes one file for each record, under the record's own name.

``df.write.format("record_files")`` takes rows of ``name`` (a path below the folder) and ``body`` (text or bytes). Each task
writes to a folder of its own attempt below a hidden one of the job; files are moved into place when the job commits, so of a task or
job that fails nothing shows. Its hidden folder goes; what a task writes there while it's being killed is cleared by the first
commit that finds it a day old. A file that exists is replaced by the new one whole. Folders can be local or in any store that Arrow opens (HDFS, S3,
GCS). Null bodies are empty; rows without a name, or with one that leads out of the folder, are an error.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files that the driver moves at once.
MOVERS = 16
#: Seconds after which a hidden folder belongs to no job that still runs.
STALE = 86_400


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class RecordWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return f"{root}/.pending-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = opened(self.path)
        context = TaskContext.get()
        folder = f"{self._pending(root)}/{context.partitionId()}-{context.taskAttemptId()}" if context else f"{self._pending(root)}/0"
        made: set[str] = set()
        count = 0
        try:
            for row in iterator:
                name = posixpath.normpath(row["name"] or "")
                if name in (".", "..") or name.startswith(("/", "../")):
                    raise ValueError(f"not a name of a file: {row['name']!r}")
                place = f"{folder}/{name}"
                if (parent := posixpath.dirname(place)) not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                body = row["body"]
                with store.open_output_stream(place) as out:
                    out.write(body.encode() if isinstance(body, str) else bytes(body or b""))
                count += 1
        except BaseException:
            if made:
                store.delete_dir(folder)
            raise
        return Written(folder, count)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        made: set[str] = set()

        def move(pair: tuple[str, str]) -> None:
            store.move(*pair)

        with ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:  # a task's files at a time
                if m is None or not m.files:
                    continue
                found = [f.path for f in store.get_file_info(fs.FileSelector(m.folder, recursive=True)) if f.is_file]
                pairs = [(f, f"{root}/{f[len(m.folder) + 1 :]}") for f in found]
                for parent in {posixpath.dirname(to) for _, to in pairs} - made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                list(pool.map(move, pairs))
        self._clear(store, root)
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith(".pending-") and info.mtime and time.time() - info.mtime.timestamp() > STALE:
                store.delete_dir(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(self._pending(root)).type == fs.FileType.Directory:
            store.delete_dir(self._pending(root))


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        if not {"name", "body"} <= set(schema.names):
            raise ValueError("record_files writes rows of name and body")
        return RecordWriter(self.options["path"].rstrip("/"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordFiles)

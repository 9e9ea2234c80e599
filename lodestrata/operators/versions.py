"""A keyed table of versions that share files: writes add files and name the rows they replace, reads merge.

A version is a manifest: the data files it holds, with rows, bytes and range of keys of each, and the folders of deletes beside
them. A delete is a row (file, key), so it hides one row of one file and files without deletes are read as they are; only
files that have some are joined with them. A write of a batch looks the batch's keys up in files whose key range it meets,
reading just keys and times, writes the batch's rows and the deletes of what they replace, and nothing else. Files whose rows
are mostly gone, and small files once there are many, are written again within such a write (``settle``).

Pointers are numbered and made by a rename that doesn't overwrite: a pointer is there whole or not at all, a taken number means
a finished writer, so of two writers that read the same version the second fails and nothing is lost. Restoring, rolling back
and taking over another table's version (``adopt``) write manifests and pointers only. A version that drops out of the history
takes along the folders that no other version holds, here or in a table that has adopted from here.

Manifests are the driver's: some 200 bytes for each file of up to ``FILE_ROWS`` rows. Null keys are equal to each other.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import shared_dir, stored
from .store import newest

#: Most rows of a data file, the share of gone rows beyond which a file is written again, and how many small files (of under a
#: quarter of the rows) are borne before they're put together.
FILE_ROWS = 1_000_000
MOST_GONE = 0.3
SMALL_FILES = 32
#: Pointers that are kept for readers that have just read them.
POINTERS = 10


@dataclass
class DataFile:
    """``root`` is empty for the table's own files. ``low`` and ``high`` bound the keys; None if they aren't known. ``settled``
    files come from writing a table or its small files anew; to do so again would change nothing."""

    path: str
    rows: int
    bytes: int
    low: list | None = None
    high: list | None = None
    gone: int = 0
    root: str = ""
    settled: bool = False

    @property
    def name(self) -> str:
        return self.path.rpartition("/")[2]


@dataclass
class Deletes:
    """A folder of deletes, and how many rows of which file they hide."""

    path: str
    files: dict[str, int]
    root: str = ""


@dataclass
class Manifest:
    schema: str
    files: list[DataFile] = field(default_factory=list)
    deletes: list[Deletes] = field(default_factory=list)
    note: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def read(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(d["schema"], [DataFile(**f) for f in d["files"]], [Deletes(**x) for x in d["deletes"]], d["note"])

    def folders(self, root: str) -> set[str]:
        """Folders that the version reads, in full."""
        return {f"{f.root or root}/{f.path.rpartition('/')[0]}" for f in self.files} | {f"{d.root or root}/{d.path}" for d in self.deletes}


def _ordered(key: list) -> tuple:
    """A key that compares as Spark compares it: nulls first."""
    return tuple((v is not None, v) for v in key)


class Snapshots:
    """Versions of a table below one folder. ``keys`` are the columns that name a row, for writes of less than all rows; of
    rows with one key the one with the greatest ``by`` stays."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str] | None = None, by: str | None = None):
        self.spark, self.root, self.keys, self.by = spark, root.rstrip("/"), keys or [], by
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        path = self._path(self.root)
        self.fs = path.getFileSystem(self._conf)
        self.fs.mkdirs(path)

    # --- files ---

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def _text(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Make a file with this text, whole; False if there is one already."""
        folder, _, name = path.rpartition("/")
        self.fs.mkdirs(self._path(folder))
        draft = self._path(f"{folder}/.{name}.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            rename = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
            self._hadoop.FileContext.getFileContext(self.fs.getUri(), self._conf).rename(draft, self._path(path), rename)
        except Exception as e:  # told by name, as Py4J wraps it
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}" if folder else self.root)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    # --- pointers and manifests ---

    def _numbers(self) -> list[int]:
        """The numbers of the pointers, the newest first."""
        return sorted((int(n[8:-5]) for n in self._names("") if n.startswith("CURRENT-") and n.endswith(".json")), reverse=True)

    def _read_pointer(self) -> dict:
        for n in self._numbers()[:1]:
            return json.loads(self._text(f"{self.root}/CURRENT-{n}.json"))
        return {"current": None, "history": [], "number": 0}

    def _point(self, state: dict) -> None:
        """Make the pointer after the one that ``state`` was read from; an error if another writer has."""
        number = state["number"] + 1
        if not self._create(f"{self.root}/CURRENT-{number}.json", json.dumps(state | {"number": number})):
            raise RuntimeError(f"{self.root} was changed by another writer")
        for old in self._numbers()[POINTERS:]:
            self.fs.delete(self._path(f"{self.root}/CURRENT-{old}.json"), False)

    def _manifest(self, name: str) -> Manifest:
        return Manifest.read(self._text(f"{self.root}/versions/{name}.json"))

    def _now(self) -> tuple[dict, Manifest | None]:
        state = self._read_pointer()
        return state, self._manifest(state["current"]) if state["current"] else None

    def list(self) -> list[str]:
        return self._read_pointer()["history"]

    def note(self) -> dict:
        """What was noted with the current version."""
        _, manifest = self._now()
        return manifest.note if manifest else {}

    def _publish(self, state: dict, manifest: Manifest, keep: int) -> str:
        """Make a manifest the current version, after the one that ``state`` was read from."""
        name = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        self._create(f"{self.root}/versions/{name}.json", manifest.text())
        history = [*state["history"], name]
        left, kept = history[: -(keep + 1)], history[-(keep + 1) :]
        self._point({"number": state["number"], "current": name, "history": kept})
        if left:
            self._forget(left, kept)
        return name

    def _forget(self, left: list[str], kept: list[str]) -> None:
        """Drop versions and the folders that only they hold."""
        held = set().union(*[self._manifest(n).folders(self.root) for n in kept])
        lent: set[str] = set()
        for pin in self._notes("pins"):
            other = Snapshots(self.spark, pin["root"])
            lent |= set().union(*[other._manifest(n).folders(other.root) for n in other.list()])
        # what only others held when it was left here may be free by now
        loose = {note["folder"] for note in self._notes("lent")}.union(*[self._manifest(n).folders(self.root) for n in left])
        for folder in loose - held:
            note = f"{self.root}/lent/{folder.rpartition('/')[2]}.json"
            if folder in lent:
                self._create(note, json.dumps({"folder": folder}))
            elif folder.startswith(f"{self.root}/"):  # others' files are theirs
                self.fs.delete(self._path(folder), True)
                self.fs.delete(self._path(note), False)
        for name in left:
            self.fs.delete(self._path(f"{self.root}/versions/{name}.json"), False)

    def _notes(self, folder: str) -> list[dict]:
        return [json.loads(self._text(f"{self.root}/{folder}/{n}")) for n in self._names(folder) if n.endswith(".json") and not n.startswith(".")]

    # --- reading ---

    def _scan(self, manifest: Manifest, files: list[DataFile], columns: list[str], named: bool = False) -> DataFrame:
        """Columns of the live rows of some files; with ``named``, ``__file`` too."""
        schema = StructType.fromJson(json.loads(manifest.schema))
        file = F.col("_metadata.file_name").alias("__file")

        def read(some: list[DataFile]) -> DataFrame:
            return self.spark.read.schema(schema).parquet(*[f"{f.root or self.root}/{f.path}" for f in some])

        whole, holed = [f for f in files if not f.gone], [f for f in files if f.gone]
        parts = []
        if whole:
            parts.append(read(whole).select(*columns, *([file] if named else [])))
        if holed:
            rows = read(holed).select(*dict.fromkeys([*columns, *self.keys]), file)
            names = {f.name for f in holed}
            gone = self.spark.read.schema(self._gone_schema(schema)).parquet(*[f"{d.root or self.root}/{d.path}" for d in manifest.deletes if names & set(d.files)])
            gone = gone.select(*[F.col(c).alias(f"__gone{i}") for i, c in enumerate(["__file", *self.keys])])
            same = [F.col("__file") == F.col("__gone0"), *[F.col(c).eqNullSafe(F.col(f"__gone{i}")) for i, c in enumerate(self.keys, 1)]]
            parts.append(rows.join(gone, functools.reduce(Column.__and__, same), "left_anti").select(*columns, *(["__file"] if named else [])))
        if not parts:
            fields = [schema[c] for c in columns] + ([StructField("__file", StringType())] if named else [])
            return self.spark.createDataFrame([], StructType(fields))
        return functools.reduce(DataFrame.unionByName, parts)

    def _gone_schema(self, schema: StructType) -> StructType:
        return StructType([StructField("__file", StringType()), *[schema[k] for k in self.keys]])

    def current(self) -> DataFrame | None:
        _, manifest = self._now()
        return None if manifest is None else self._scan(manifest, manifest.files, StructType.fromJson(json.loads(manifest.schema)).names)

    def sizes(self) -> dict[str, int]:
        """Bytes that the current version reads, by file."""
        _, manifest = self._now()
        return {f.name: f.bytes for f in manifest.files} if manifest else {}

    # --- writing ---

    def _write(self, rows: DataFrame, schema: StructType, settled: bool = False, count: int | None = None) -> list[DataFile]:
        """Rows as data files, laid out by key (within cells, where there are any), in as few as hold ``count`` rows if that is
        given; rows are read twice, so they should be stored if they cost much."""
        by = [c for c in (["collection", "cell", "chunk_id"] if {"collection", "cell", "chunk_id"} <= set(schema.names) else self.keys) if c in schema.names]
        parts = [] if count is None else [max(1, -(-count // FILE_ROWS))]
        laid = rows.repartitionByRange(*parts, *by).sortWithinPartitions(*by) if by else rows.hint("rebalance")
        folder = f"data/w{uuid.uuid4().hex}"
        laid.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.root}/{folder}")
        bytes_of = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path(f"{self.root}/{folder}"))}
        back = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").select(F.col("_metadata.file_name").alias("file"), *self.keys)
        bounds = [F.min(F.struct(*self.keys)).alias("low"), F.max(F.struct(*self.keys)).alias("high")] if self._bounded(schema) else []
        # one row for each new file
        told = back.groupBy("file").agg(F.count("*").alias("rows"), *bounds).collect()
        return [DataFile(f"{folder}/{r.file}", r.rows, bytes_of[r.file], list(r.low) if bounds else None, list(r.high) if bounds else None, settled=settled) for r in sorted(told, key=lambda r: r.file)]

    def _bounded(self, schema: StructType) -> bool:
        return bool(self.keys) and all(schema[k].dataType.simpleString() in ("string", "bigint", "int", "smallint", "tinyint", "boolean") for k in self.keys)

    def publish(self, rows: DataFrame, keep: int, note: dict | None = None) -> str:
        """Make all these rows the new version, and drop all but the newest ``keep`` before it."""
        state = self._read_pointer()
        return self._publish(state, Manifest(rows.schema.json(), self._write(rows, rows.schema, True), [], note or {}), keep)

    def _met(self, manifest: Manifest, keys: DataFrame) -> list[DataFile]:
        """Files whose key range meets some of ``keys``, which are stored in ranges: a range for each of their files is collected."""
        if not all(f.low is not None for f in manifest.files):
            return manifest.files
        key = F.struct(*self.keys)
        ranges = keys.groupBy(F.col("_metadata.file_name")).agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
        ends: list[tuple[tuple, tuple]] = []
        for low, high in sorted((_ordered(r.low), _ordered(r.high)) for r in ranges):
            ends.append((low, max(high, ends[-1][1]) if ends else high))
        lows = [low for low, _ in ends]

        def meets(f: DataFile) -> bool:
            at = bisect.bisect_right(lows, _ordered(f.high or []))
            return at > 0 and ends[at - 1][1] >= _ordered(f.low or [])

        return [f for f in manifest.files if meets(f)]

    def _staged(self, rows: DataFrame) -> DataFrame:
        """Rows laid out by key, stored."""
        return stored(rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys))

    def _same_key(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        renamed = right.withColumnsRenamed({k: f"__right{i}" for i, k in enumerate(self.keys)})
        return left.join(renamed, functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__right{i}")) for i, k in enumerate(self.keys)]), how)

    def _change(self, state: dict, manifest: Manifest, rows: DataFrame | None, gone: DataFrame | None, keep: int, note: dict | None) -> str:
        """A version with more rows and with (file, key) rows gone."""
        schema = StructType.fromJson(json.loads(manifest.schema))
        files = [DataFile(**asdict(f)) for f in manifest.files]
        deletes = list(manifest.deletes)
        if gone is not None:
            path = f"deletes/d{uuid.uuid4().hex}"
            gone.select("__file", *self.keys).distinct().write.parquet(f"{self.root}/{path}")
            # one row for each file that's touched
            counts = {r["__file"]: r["count"] for r in self.spark.read.schema(self._gone_schema(schema)).parquet(f"{self.root}/{path}").groupBy("__file").count().collect()}
            for f in files:
                f.gone += counts.get(f.name, 0)
            if counts:
                deletes.append(Deletes(path, counts))
            else:
                self.fs.delete(self._path(f"{self.root}/{path}"), True)
        if rows is not None:
            files += self._write(rows, schema)
        return self._publish(state, self._settled(Manifest(manifest.schema, files, deletes, note or {})), keep)

    def _settled(self, manifest: Manifest, every: bool = False) -> Manifest:
        """Without files that are all gone; files with many gone rows, and small ones once many have been added (or, with ``every``,
        if there are two), are written again."""
        files = [f for f in manifest.files if f.gone < f.rows]
        small = [f for f in files if f.rows - f.gone < FILE_ROWS // 4]
        chosen = [f for f in files if f.gone > MOST_GONE * f.rows]
        together = len(small) > 1 if every else sum(not f.settled for f in small) > SMALL_FILES
        if together:
            chosen = [f for f in files if f in chosen or f in small]
        if chosen:
            schema = StructType.fromJson(json.loads(manifest.schema))
            rows = self._scan(manifest, chosen, schema.names)
            files = [f for f in files if f not in chosen] + self._write(rows, schema, together, sum(f.rows - f.gone for f in chosen))
        left = {f.name for f in files if f.gone}
        return Manifest(manifest.schema, files, [d for d in manifest.deletes if left & set(d.files)], manifest.note)

    def compact(self, keep: int) -> str | None:
        """Write small and mostly gone files again now; None if there is nothing to do."""
        state, manifest = self._now()
        if manifest is None:
            return None
        settled = self._settled(manifest, True)
        return self._publish(state, settled, keep) if settled.files != manifest.files else None

    def upsert(self, batch: DataFrame, keep: int, gone: DataFrame | None = None, note: dict | None = None) -> str:
        """Rows with a new key are added; of rows with one key the one with the greatest ``by`` stays, the batch's on ties.
        ``gone`` names, by any columns, rows of the table that go before that."""
        by = F.col(self.by) if self.by else F.lit(0)
        staged = self._staged(newest(batch, self.keys, [by.desc_nulls_last()]))
        state, manifest = self._now()
        if manifest is None:
            return self._publish(state, Manifest(staged.schema.json(), self._write(staged, staged.schema), [], note or {}), keep)
        folder = shared_dir(self.spark)
        cleared = stored(self._found(manifest, gone), f"{folder}/cleared") if gone is not None else None
        time_of = [self.by] if self.by else []
        base = self._scan(manifest, self._met(manifest, staged), [*self.keys, *time_of], True)
        if cleared is not None:
            base = base.join(cleared.select("__file", *[F.col(k).alias(f"__c{i}") for i, k in enumerate(self.keys)]).withColumnRenamed("__file", "__c"), functools.reduce(Column.__and__, [F.col("__file") == F.col("__c"), *[F.col(k).eqNullSafe(F.col(f"__c{i}")) for i, k in enumerate(self.keys)]]), "left_anti")
        new_time = staged.select(*self.keys, by.alias("__by"))
        # the base's row stays if its time is greater; null is the least
        older = F.col(self.by).isNull() | F.coalesce(F.col("__by") >= F.col(self.by), F.lit(False)) if self.by else F.lit(True)
        hits = stored(self._same_key(base, new_time, "inner").select("__file", *self.keys, older.alias("replaced")), f"{folder}/hits")
        lost = hits.filter("NOT replaced").select(*self.keys)
        replaced = hits.filter("replaced").select("__file", *self.keys)
        names = StructType.fromJson(json.loads(manifest.schema)).names
        rows = self._same_key(staged.select(*names), lost, "left_anti") if self.by else staged.select(*names)
        return self._change(state, manifest, rows, replaced if cleared is None else replaced.unionByName(cleared), keep, note)

    def insert(self, batch: DataFrame, keep: int) -> str:
        """Rows whose key is new; of rows that share a new key the first by all columns stays."""
        rest = [F.col(c).asc_nulls_last() for c in batch.columns if c not in self.keys]
        staged = self._staged(newest(batch, self.keys, rest or [F.lit(0)]))
        state, manifest = self._now()
        if manifest is None:
            return self._publish(state, Manifest(staged.schema.json(), self._write(staged, staged.schema), [], {}), keep)
        known = self._scan(manifest, self._met(manifest, staged), self.keys)
        names = StructType.fromJson(json.loads(manifest.schema)).names
        return self._change(state, manifest, self._same_key(staged.select(*names), known, "left_anti"), None, keep, None)

    def _found(self, manifest: Manifest, gone: DataFrame) -> DataFrame:
        """(file, key) of the live rows that agree with a row of ``gone`` in its columns; other columns aren't read."""
        on = gone.columns
        files = manifest.files
        if set(on) == set(self.keys):
            gone = self._staged(gone.distinct())
            files = self._met(manifest, gone)
        rows = self._scan(manifest, files, list(dict.fromkeys([*self.keys, *on])), True)
        return rows.join(gone.distinct(), on, "left_semi").select("__file", *self.keys)

    def delete(self, gone: DataFrame, keep: int) -> str:
        """Without the rows that agree with a row of ``gone`` in its columns."""
        state, manifest = self._now()
        if manifest is None:
            raise ValueError("there is no version to delete from")
        return self._change(state, manifest, None, self._found(manifest, gone), keep, manifest.note)

    def delete_where(self, condition: Column, columns: list[str], keep: int) -> str:
        """Without the rows for which a condition on ``columns`` is true."""
        state, manifest = self._now()
        if manifest is None:
            raise ValueError("there is no version to delete from")
        found = self._scan(manifest, manifest.files, list(dict.fromkeys([*self.keys, *columns])), True).filter(condition)
        return self._change(state, manifest, None, found.select("__file", *self.keys), keep, manifest.note)

    def adopt(self, other: Snapshots, keep: int) -> str:
        """Make the current version of another table this one's, without copying: its files stay where they are, and the
        other table keeps them as long as a version here holds them."""
        state = self._read_pointer()
        _, theirs = other._now()
        if theirs is None:
            raise ValueError("there is no version to adopt")
        if other.root != self.root:
            other._create(f"{other.root}/pins/{hashlib.sha256(self.root.encode()).hexdigest()[:16]}.json", json.dumps({"root": self.root}))
        files = [DataFile(**asdict(f) | {"root": f.root or other.root}) for f in theirs.files]
        return self._publish(state, Manifest(theirs.schema, files, [Deletes(d.path, d.files, d.root or other.root) for d in theirs.deletes], theirs.note), keep)

    def restore(self, name: str) -> None:
        state = self._read_pointer()
        if name not in state["history"]:
            raise ValueError(f"no snapshot {name}")
        self._point(state | {"current": name})

    def rollback(self) -> str:
        """Back to the version before the current one."""
        state = self._read_pointer()
        at = state["history"].index(state["current"]) if state["current"] else 0
        if at < 1:
            raise ValueError("there is no version to go back to")
        self.restore(state["history"][at - 1])
        return state["history"][at - 1]

"""Vector code compression: product codebooks fitted by Lloyd's rounds over all vectors, which heaps make lazy.

Vectors become whole numbers floor(scale * x) and are cut into consecutive parts; each part position has a codebook. Rows
lie in blocks; for each part position a block holds one heap per codebook entry over the parts assigned to it. A part's
key is its slack (distance to the second nearest entry minus the distance to its own) plus the drift that its entry had
gathered when the key was made. When entries move, an entry's drift grows by its own step plus the longest step of another
entry: as long as a key is above its entry's drift, no other entry can be nearer. So a round pops only the parts whose
bounds are violated, compares just these with all entries exactly, and pushes them again; a heap whose least key holds
isn't opened. Sums are kept up by what changed its entry alone.

Each round is one narrow pass over blocks that are written to the shared folder, the new state in, the old one dropped;
what is shuffled are sums per entry that moved parts, and what reaches the driver is one row for each entry. Distances and
sums are whole numbers, exact at any size; square roots serve only as bounds, with a margin, so parts on a tie are popped
and settled exactly (the lower index wins).

Rows whose vector is null or holds a null or non-finite component take no part; nor do, where lengths differ, vectors of
other lengths than the most frequent (of equally frequent ones the shorter). If the length isn't a multiple of the parts,
the first parts are one component longer. Codebooks start at the vectors of the smallest ids; rows that repeat an id count
each, of equal ids the smaller vector comes first, rows without an id last. With fewer rows than entries, codebooks are as
small. Components are held to +-2**50, errors to the range of long. An empty table gives no rows. Other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

from .common import keyed_join, shared_dir, stored
from .vectors import EXACT, kept

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024.0
#: Rows and bytes of vectors in a block; files of blocks are cut into row groups of so many bytes, as a reader holds one.
BLOCK_ROWS, BLOCK_BYTES = 2048, 512 << 10
GROUP_BYTES = 16 << 20
LIMIT = float(1 << 50)
LONG = (1 << 63) - 1
_STATE = "vectors binary, width string, heaps array<struct<parts:binary,keys:binary,sizes:binary>>, moved array<struct<position:int,entry:int,n:long,sums:array<long>>>"


def bounds(size: int, parts: int) -> list[int]:
    """Where parts begin, and the end."""
    return [i * (size // parts) + min(i, size % parts) for i in range(parts + 1)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors: float64 while everything stays below 2**53, else Python's integers."""
    top = float(np.abs(a).max(initial=0)) + float(np.abs(b).max(initial=0))
    if 4 * top * top * max(1, a.shape[1]) < EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
    x, y = a.astype(object), b.astype(object)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


@dataclass
class Codebooks:
    """Entries of each part position, the sums and counts behind them, and the drift each entry has gathered."""

    entries: list[np.ndarray]
    drift: list[np.ndarray] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.drift = self.drift or [np.zeros(len(e)) for e in self.entries]
        self.sums = self.sums or [np.zeros(e.shape, dtype=object) for e in self.entries]
        self.counts = self.counts or [np.zeros(len(e), dtype=object) for e in self.entries]

    def move(self, moved: list[tuple[int, int, int, list[int]]]) -> Codebooks:
        """Take in what changed its entry, and set every entry to the floored mean of its parts; unused ones stay."""
        for position, entry, n, sums in moved:
            self.counts[position][entry] += n
            self.sums[position][entry] += np.array([int(v) for v in sums], dtype=object)
        entries, drift = [], []
        for old, gathered, sums, counts in zip(self.entries, self.drift, self.sums, self.counts, strict=True):
            new = old.copy()
            for j in range(len(old)):
                if counts[j]:
                    new[j] = [int(s) // int(counts[j]) for s in sums[j]]
            step = roots(((new - old).astype(object) ** 2).sum(axis=1)) if len(old) else np.zeros(0)
            others = np.zeros(len(old))
            if len(old) > 1:
                order = np.argsort(step)
                others[:] = step[order[-1]]
                others[order[-1]] = step[order[-2]]
            entries.append(new)
            drift.append(gathered + (step + others) * (1 + 1e-9))
        return Codebooks(entries, drift, self.sums, self.counts)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.ravel()).encode()).hexdigest()


class Heaps:
    """The heaps of one part position in one block: rows in heap order, entry by entry, with their keys."""

    def __init__(self, parts: np.ndarray, keys: np.ndarray, sizes: np.ndarray):
        self.parts, self.keys, self.sizes = parts, keys, sizes

    @staticmethod
    def _safe(drift: np.ndarray) -> np.ndarray:
        """Keys above this hold for certain."""
        return drift * (1 + 1e-9) + 1e-6

    @classmethod
    def new(cls, vectors: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray]:
        """Heaps of parts that have no entry yet."""
        nearest, slack = cls._scan(vectors, book)
        keys = slack + drift[nearest]
        # sorted keys are a heap
        order = np.lexsort((keys, nearest))
        return cls(order.astype(np.int32), keys[order], np.bincount(nearest, minlength=len(book)).astype(np.int32)), nearest

    @staticmethod
    def _scan(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (of equals the first) and slack of each part, with a margin for rounding."""
        d = distances(vectors, book)
        nearest = d.argmin(axis=1)
        if d.shape[1] == 1:
            return nearest, np.full(len(d), np.inf)
        rows = np.arange(len(d))
        best = roots(d[rows, nearest])
        d[rows, nearest] = d.max(initial=0) + 1
        second = roots(d.min(axis=1))
        return nearest, second * (1 - 1e-12) - best * (1 + 1e-12)

    def rescan(self, vectors: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pop what drift has violated, find its entry exactly, push it; gives the rows that changed, from where and to."""
        safe = self._safe(drift)
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        used = np.nonzero(self.sizes)[0]
        loose = used[self.keys[starts[used]] <= safe[used]]
        if not len(loose):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        opened: dict[int, list[tuple[float, int]]] = {}

        def heap(j: int) -> list[tuple[float, int]]:
            if j not in opened:
                part = slice(starts[j], ends[j])
                opened[j] = list(zip(self.keys[part].tolist(), self.parts[part].tolist(), strict=True))
            return opened[j]

        rows: list[int] = []
        was: list[int] = []
        for j in loose.tolist():
            h, limit = heap(j), safe[j]
            while h and h[0][0] <= limit:
                rows.append(heapq.heappop(h)[1])
                was.append(j)
        popped, before = np.array(rows), np.array(was)
        nearest, slack = self._scan(vectors[popped], book)
        for row, j, key in zip(rows, nearest.tolist(), (slack + drift[nearest]).tolist(), strict=True):
            heapq.heappush(heap(j), (key, row))
        parts, keys = [], []
        for j in range(len(self.sizes)):
            if j in opened:
                parts.append(np.array([r for _, r in opened[j]], dtype=np.int32))
                keys.append(np.array([k for k, _ in opened[j]], dtype=np.float64))
                self.sizes[j] = len(opened[j])
            else:
                parts.append(self.parts[starts[j] : ends[j]])
                keys.append(self.keys[starts[j] : ends[j]])
        self.parts, self.keys = np.concatenate(parts), np.concatenate(keys)
        changed = nearest != before
        return popped[changed], before[changed], nearest[changed]

    def assigned(self) -> np.ndarray:
        """The entry of each row."""
        out = np.zeros(len(self.parts), dtype=np.int64)
        out[self.parts] = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return out


def _floored(batch: pa.RecordBatch, scale: float) -> np.ndarray:
    values = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int64).reshape(batch.num_rows, -1)


def _packed(vectors: np.ndarray) -> tuple[bytes, str]:
    width = next(w for w in ("<i2", "<i4", "<i8") if np.abs(vectors).max(initial=0) <= np.iinfo(w).max)
    return vectors.astype(width).tobytes(), width


def _moves(vectors: np.ndarray, rows: np.ndarray, entries: np.ndarray, sign: int, out: dict[int, list]) -> None:
    """Add (or take) rows to the sums of their entries."""
    order = np.argsort(entries, kind="stable")
    for some in np.split(order, np.nonzero(np.diff(entries[order]))[0] + 1) if len(order) else []:
        total = out.setdefault(int(entries[some[0]]), [0, np.zeros(vectors.shape[1], dtype=np.int64)])
        total[0] += sign * len(some)
        total[1] += sign * vectors[rows[some]].sum(axis=0)


def _told(moves: list[dict[int, list]]) -> list[dict]:
    return [{"position": p, "entry": j, "n": n, "sums": s.tolist()} for p, by in enumerate(moves) for j, (n, s) in sorted(by.items())]


def _blocks(schema: pa.Schema, parts: int, scale: float, book: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows into blocks, each part with its first entry."""
    books: Codebooks = book.value
    cut = bounds(sum(e.shape[1] for e in books.entries), parts)
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, 2 * cut[-1])))
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        rows = table.to_batches()[0]
        vectors = _floored(rows, scale)
        heaps, moves = [], []
        every = np.arange(len(vectors))
        for p in range(parts):
            part = vectors[:, cut[p] : cut[p + 1]]
            h, nearest = Heaps.new(part, books.entries[p], books.drift[p])
            moves.append({})
            _moves(part, every, nearest, 1, moves[p])
            heaps.append({"parts": h.parts.tobytes(), "keys": h.keys.tobytes(), "sizes": h.sizes.tobytes()})
        data, width = _packed(vectors)
        lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), c) for c in rows.columns[:-1]]
        rest = [pa.array([v], type=f.type) for v, f in zip((data, width, heaps, _told(moves)), list(schema)[len(lists) :], strict=True)]
        return pa.RecordBatch.from_arrays([*[a.cast(f.type) for a, f in zip(lists, schema, strict=False)], *rest], schema=schema)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            room = most - sum(b.num_rows for b in held)
            held.append(batch.slice(at, room))
            at += room
            if sum(b.num_rows for b in held) == most:
                yield block()
                held = []
    if held:
        yield block()


def _round(book: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A round over blocks: violated parts find their entry again."""
    books: Codebooks = book.value
    cut = np.cumsum([0, *[e.shape[1] for e in books.entries]]).tolist()
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            state = {c: row.column(c)[0].as_py() for c in ("vectors", "width", "heaps")}
            vectors = np.frombuffer(state["vectors"], dtype=state["width"]).reshape(-1, cut[-1]) if cut[-1] else None
            heaps, moves = [], []
            for p, h in enumerate(state["heaps"]):
                was = Heaps(np.frombuffer(h["parts"], np.int32), np.frombuffer(h["keys"]), np.frombuffer(h["sizes"], np.int32).copy())
                part = vectors[:, cut[p] : cut[p + 1]] if vectors is not None else np.zeros((len(was.parts), 0), dtype=np.int64)
                rows, before, after = was.rescan(part, books.entries[p], books.drift[p])
                moves.append({})
                whole = part.astype(np.int64) if len(rows) else part
                _moves(whole, rows, before, -1, moves[p])
                _moves(whole, rows, after, 1, moves[p])
                heaps.append({"parts": was.parts.tobytes(), "keys": was.keys.tobytes(), "sizes": was.sizes.tobytes()})
            new = {"heaps": [heaps], "moved": [_told(moves)]}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], type=row.schema.field(c).type) if c in new else row.column(c) for c in names], schema=batch.schema)


def _rows(schema: pa.Schema, n: int, book: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks back into rows: what was kept, the entries' indexes and the exact error."""
    books: Codebooks = book.value
    cut = np.cumsum([0, *[e.shape[1] for e in books.entries]]).tolist()
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            heaps = [Heaps(np.frombuffer(h["parts"], np.int32), np.frombuffer(h["keys"]), np.frombuffer(h["sizes"], np.int32)) for h in row.column("heaps")[0].as_py()]
            count = len(heaps[0].parts)
            vectors = np.frombuffer(row.column("vectors")[0].as_py(), dtype=row.column("width")[0].as_py()).reshape(count, -1)
            codes = np.stack([h.assigned() for h in heaps], axis=1)
            error = np.zeros(count, dtype=object)
            for p, e in enumerate(books.entries):
                away = vectors[:, cut[p] : cut[p + 1]].astype(np.int64) - e[codes[:, p]]
                if float(np.abs(away).max(initial=0)) ** 2 * max(1, away.shape[1]) >= EXACT:
                    away = away.astype(object)
                error += (away * away).sum(axis=1)
            offsets = pa.array(np.arange(count + 1, dtype=np.int32) * len(heaps))
            yield pa.RecordBatch.from_arrays(
                [*[row.column(k).flatten() for k in range(n)], pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int32))).cast(schema.field("entries").type), pa.array([min(int(v), LONG) for v in error], pa.int64())], schema=schema
            )


def compress(
    df: DataFrame, keep: list[str], entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, Codebooks]:
    """The columns ``keep``, ``entries`` (index in each part's codebook) and ``error`` (squared distance) of every vector
    that takes part, and the codebooks, after ``rounds`` rounds and a last assignment."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keep))]
    ident = F.col(f"`{id_col}`").alias("__id")
    rows, n, size = kept(df, [*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, names, strict=True)], ident], vector_col)
    flat = _parse_datatype_string(", ".join([*(f"{a} {kinds[c]}" for c, a in zip(keep, names, strict=True)), "entries array<int>, error long"]))
    assert isinstance(flat, StructType)

    def named(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(a).alias(c) for c, a in zip(keep, names, strict=True)], "entries", "error")

    # as many rows as a codebook has entries
    first = rows.orderBy(F.col("__id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().combine_chunks()
    cut = bounds(size, parts)
    start = _floored(first.to_batches()[0], scale) if n else np.zeros((0, 0), dtype=np.int64)
    books = Codebooks([start[:, cut[p] : cut[p + 1]] for p in range(parts)])
    if not n:
        return named(spark.createDataFrame([], flat)), books
    kept_fields = StructType([f for f in flat.fields if f.name in names])
    state = _parse_datatype_string(_STATE)
    assert isinstance(state, StructType)
    packed = StructType()
    for f in kept_fields.fields:
        packed.add(f.name, ArrayType(f.dataType))
    for f in state.fields:
        packed.add(f)
    folder = shared_dir(spark)

    def written(out: DataFrame, number: int) -> DataFrame:
        path = f"{folder}/round{number}"
        out.write.option("parquet.block.size", str(GROUP_BYTES)).option("parquet.block.size.row.check.min", "10").parquet(path)
        if number:  # the state before is read no more
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/round{number - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return spark.read.schema(packed).parquet(path)

    narrow = rows.select(*names, "vector")
    blocks = written(narrow.mapInArrow(functools.partial(_blocks, to_arrow_schema(packed), parts, scale, spark.sparkContext.broadcast(books)), packed), 0)
    for number in range(1, rounds + 1):
        widest = max(e.shape[1] for e in books.entries)
        moved = blocks.select(F.inline("moved")).groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(widest)])
        # one row for each entry at most
        books = books.move([(r[0], r[1], r[2], list(r[3 : 3 + books.entries[r[0]].shape[1]])) for r in moved.collect()])
        blocks = written(blocks.mapInArrow(functools.partial(_round, spark.sparkContext.broadcast(books)), packed), number)
    return named(blocks.drop("moved").mapInArrow(functools.partial(_rows, to_arrow_schema(flat), len(names), spark.sparkContext.broadcast(books)), flat)), books


def hex_code(entries: str = "entries", digits: int = 2):
    """The indexes in part order, each in as many hexadecimal digits."""
    return F.lower(F.array_join(F.transform(entries, lambda x: F.lpad(F.hex(x), digits, "0")), ""))


def with_label_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """``label_error``: the errors summed over the rows with an equal label, null labels together."""
    key = F.when(F.col(label).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(label).cast("string")))
    rows = stored(rows.withColumn("__label", key))
    sums = stored(rows.groupBy("__label").agg(F.count("*").alias("__rows"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error")))
    return keyed_join(rows, sums, "__label", "__rows", ["label_error"]).drop("__label")

"""Harmonic packing of documents into sequences of bounded length.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k], and each of its bins takes just
k pieces, so a worker fills bins without looking at other classes or other workers and holds fewer than k open pieces
for each class. Plain harmonic bins waste what their lengths fall short of C/k. As documents may be cut, one whose class
would waste more than ``waste`` of its share is cut at the next class's full length floor(C/(k+1)) and the short rest is
classed again, at most ``cuts`` times; what then is wasted in a bin is a few tokens. At the end of a partition, the open
pieces of all classes are laid end to end and cut at the capacity, and the last stretch into lengths that are powers of
two, which need no padding.

One narrow pass over the documents; no shuffle. A sequence's number holds its partition's number, so lost tasks give the
same sequences again. Null and empty texts hold only the closing id. Repeated rows are packed each for itself, rows without
an id too. Very long texts are read in slices, whole; their ids are held, four bytes each. The strings of the tokenizer's
special tokens in a text are those tokens. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DROPS, map_rows, slices, text_bytes, tokenizer_file

CAPACITY = 2048
END_ID = 1
END = np.array([END_ID], dtype="<u4")
#: Larger classes aren't told apart: their bins take pieces until the next doesn't fit.
MAX_CLASS = 64
MEMO_WORDS = 500_000
#: Bytes of texts whose words are told apart at once.
BLOCK = 8 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of whole texts, put together from the ids of their words.

    The tokenizer's own splitting never joins text across white space, so a text's ids are its words' ids in a row. Arrow
    tells the words of a block of texts apart, and those of Latin-1 letters with or without ASCII marks behind them into
    lower-case letters and marks, which the tokenizer's normalizing and splitting leave whole. Of what then is left, each is
    looked up once a block. New letters go right to the model, anything else takes the full way; some ``MEMO_WORDS`` are
    remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.memo: dict[bytes, bytes] = {}
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        self.letters = {ord(x): self.tokenizer.pre_tokenizer.pre_tokenize_str(x)[0][0] for x in letters if x == x.lower()}
        self.plain = f"^(?P<core>[{''.join(letters)}]+)(?P<marks>[!-/:-@\\[-`{{-~]*)$"
        # only for tokenizers that lower-case and see a run of letters as one piece, and one of marks as another
        probe = [("THANdat", ""), ("éÈñ", ""), ("oftheati", ""), ("that", ","), ("that", ",$$$"), ("That", "'\""), ("É", ".&&&")]
        self.direct = all(self._full(core + marks) == self._core(core.lower()) + self._full(marks) for core, marks in probe)

    def _full(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _core(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(word if word.isascii() else word.translate(self.letters))]).tobytes()

    def _made(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        if self.direct and word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0100"):
            return self._core(word)
        return self._full(word)

    def _looked_up(self, found: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = {w: self.memo[w] for w in found if w in self.memo}
        memo = self.memo
        ids = list(map(memo.get, found))
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = memo[found[i]] = self._made(found[i])
        return ids

    def _ids(self, parts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each part; none for null."""
        found = pc.ascii_split_whitespace(pa.array(parts, pa.large_binary()).view(pa.large_string()))
        words = found.flatten().dictionary_encode()
        # a word is its letters and its marks, or itself and nothing
        split = pc.extract_regex(words.dictionary, self.plain)
        core, marks = pc.struct_field(split, "core"), pc.struct_field(split, "marks")
        if not self.direct:
            core = marks = pa.nulls(len(words.dictionary), pa.large_string())
        pieces = pa.concat_arrays([pc.coalesce(pc.utf8_lower(core), words.dictionary), pc.fill_null(marks, "")]).dictionary_encode()
        ids = _lists(self._looked_up(pieces.dictionary.view(pa.large_binary()).to_pylist()))
        ids = ids.take(pa.array(pieces.indices.to_numpy().reshape(2, -1).T.ravel()))
        ids = pa.LargeListArray.from_arrays(ids.offsets.to_numpy()[::2], ids.values)
        ids = ids.take(words.indices)
        at = ids.offsets.to_numpy()[found.offsets.to_numpy()]
        flat = ids.values.to_numpy()
        return (flat[a:b] for a, b in itertools.pairwise(at))

    def documents(self, rows: Iterable[tuple[int | None, bytes | None]]) -> Iterator[tuple[int | None, np.ndarray]]:
        """The id and the ids of each document, with the closing one; texts are read in blocks, a null closes each."""
        parts = ((doc_id, part) for doc_id, text in rows for part in itertools.chain(slices(text or b""), [None]))
        held: list[np.ndarray] = []
        for block in _blocks(parts):
            for (doc_id, part), ids in zip(block, self._ids([part for _, part in block]), strict=True):
                held.append(ids)
                if part is None:
                    yield doc_id, np.concatenate([*held, END])
                    held = []

    def encode(self, text: bytes | None) -> np.ndarray:
        return next(self.documents([(None, text)]))[1]


def _lists(ids: list[bytes]) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, ids)]) // 4, np.frombuffer(b"".join(ids), dtype="<u4"))


def _blocks(parts: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Parts of texts, some ``BLOCK`` bytes at a time."""
    block: list[tuple] = []
    size = 0
    for doc_id, part in parts:
        block.append((doc_id, part))
        size += len(part or b"") + 64
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


DROPS[__name__] = word_ids.cache_clear


def cut_points(length: int, capacity: int = CAPACITY, waste: float = 0.02, cuts: int = 3) -> list[int]:
    """Lengths to cut a document into, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    for _ in range(cuts):
        k = capacity // rest if rest else 0
        if not rest or k * rest >= (1 - waste) * capacity or k >= MAX_CLASS:
            break
        piece = capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out + [rest] * bool(rest)


class HarmonicPacker:
    """Bins of one worker. ``add`` and ``close`` give rows (piece..., sequence number, offset) of filled bins."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}
        self.number = 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece, length in pieces:
            yield piece, self.number, offset, length
            offset += length
        self.number += 1

    def add(self, piece: tuple, length: int) -> Iterator[tuple]:
        k = min(MAX_CLASS, self.capacity // length)
        held = self.open.setdefault(k, [])
        if k == MAX_CLASS:
            if sum(n for _, n in held) + length > self.capacity:
                yield from self._emit(held)
                held = self.open[k] = []
            held.append((piece, length))
            return
        held.append((piece, length))
        if len(held) == k:
            del self.open[k]
            yield from self._emit(held)

    def close(self, split) -> Iterator[tuple]:
        """The open pieces end to end; ``split(piece, n)`` cuts a piece after n ids."""
        flat = [x for k in sorted(self.open) for x in self.open[k]]
        self.open = {}
        left = sum(n for _, n in flat)
        i = 0
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            chosen = []
            while room:
                piece, n = flat[i]
                if n <= room:
                    chosen.append((piece, n))
                    i += 1
                else:
                    head, tail = split(piece, room)
                    chosen.append((head, room))
                    flat[i] = (tail, n - room)
                    n = room
                room -= min(n, room)
            yield from self._emit(chosen)


def _pack(path: str, capacity: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    encoder, packer = word_ids(path), HarmonicPacker(capacity)
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 33

    def split(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, total = piece
        return (doc_id, start, ids[:n], total), (doc_id, start + n, ids[n:], total)

    def out(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (doc_id, start, ids, total), number, offset, length in rows:
            yield doc_id, start, length, zlib.crc32(ids.tobytes()), total, base + number, offset

    for doc_id, ids in encoder.documents(rows):
        start = 0
        for n in cut_points(len(ids), capacity):
            yield from out(packer.add((doc_id, start, ids[start : start + n].copy(), len(ids)), n))
            start += n
    yield from out(packer.close(split))


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack every document; one row for each piece, with its place. The tokenizer's path must exist on the executors."""
    path = tokenizer_path or tokenizer_file("word_bpe_49k.json")
    return map_rows(docs, [F.col("doc_id").cast("long"), text_bytes()], functools.partial(_pack, path, capacity), SCHEMA)

"""Byte-level BPE: texts to ids exactly as merging by rank gives them, in linear time, and ids back to bytes.

Plain merging looks for the best pair again and again. Here the vocabulary's tokens, their bytes read as Latin-1, form one
automaton that gives the longest token from any place. A piece is covered from the left by longest tokens; two tokens
may stand side by side only if merging would leave the boundary between them alone, which depends on the two alone and
is remembered. Where a token doesn't fit after the one before, its longest shorter token is tried, then the one before is
given up and its end closed for good. Every place is closed at most once, so time is linear in the piece. As only one
cover has nothing but such boundaries, it's the one that merging ends in.

Texts are cut into pieces by the tokenizer's pattern, each encoded for itself; a piece that is a token is that token. The
pattern's letters and numbers are those of the tiktoken library, whose Unicode version may differ from that of the
``regex`` module.

Null and empty texts have no ids. Very long texts are encoded in slices that begin where pieces begin, whole. Text that
isn't UTF-8 is read with replacement characters. Repeated rows are encoded each for itself, an empty table gives no rows,
other columns (of any name) pass through if they're asked for. A vocabulary that lacks a byte, or whose merges aren't in the
order of its ranks, is an error, as is an id outside the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DROPS, SLICE, decoded, map_rows, text_bytes, tokenizer_file

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces and pairs of tokens that a worker remembers before it starts anew, and the longest piece it remembers.
MEMO_PIECES = 400_000
MEMO_PAIRS = 2_000_000
MEMO_CHARS = 64
_SHIFT = 32
_CUT = re.compile(rb"(?<=[!-~])[ \n]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class Automaton:
    """Exact BPE by ranks (rank = id) over pieces of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.ranks = ranks
        top = max(ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * top
        self.size = [0] * top
        #: When a token is made (bytes are there from the start), and the two that it's made of.
        self.made = [-1] * top
        self.left = [-1] * top
        self.right = [-1] * top
        #: The longest token that begins a token.
        self.shorter = [-1] * top
        self.pairs: dict[int, int] = {}
        self.known: dict[int, bool] = {}
        reached = {bytes([b]) for b in range(256)}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.tokens[rank], self.size[rank] = token, len(token)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and self._split(token, rank, reached):
                reached.add(token)
        self.known.clear()  # what was learned on the way holds for the merges known then
        self.automaton = ahocorasick.Automaton()
        for token in reached:
            rank = ranks[token]
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reached), -1)
        self.automaton.make_automaton()
        #: Bytes that the automaton is given at once, and the most that a token takes.
        self.longest = max(self.size)
        self.window = 8 * self.longest

    def _split(self, token: bytes, rank: int, reached: set[bytes]) -> bool:
        """Notes the two tokens whose merge makes this one; False if merging never makes it."""
        for n in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:n], -1), self.ranks.get(token[n:], -1)
            if 0 <= a and 0 <= b and token[:n] in reached and token[n:] in reached and self.made[a] < rank and self.made[b] < rank and self.apart(a, b):
                self.made[rank], self.left[rank], self.right[rank] = rank, a, b
                self.pairs[a << _SHIFT | b] = rank
                return True
        if merged(token, self.ranks) == [rank]:
            raise ValueError("the ranks aren't in the order of merges")
        return False

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the boundary between ``a`` and ``b`` alone.

        Time runs backwards: the later of the two merges beside the boundary is undone, and in no state may the two
        tokens beside it have merged before the moment at which that state ended. Of equal merges the left one comes first.
        """
        made, pairs = self.made, self.pairs
        ended = 1 << 62
        while True:
            across = pairs.get(a << _SHIFT | b)
            if across is not None and across < ended:
                return False
            when_a, when_b = made[a], made[b]
            if when_a < 0 and when_b < 0:
                return True
            if when_a > when_b:
                ended, a = when_a, self.right[a]
            else:
                ended, b = when_b + 1, self.left[b]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        size, shorter, known, longest = self.size, self.shorter, self.known, self.automaton.iter_long
        if len(known) > MEMO_PAIRS:
            known.clear()
        may_end = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at = seen = base = 0
        sure = -1  # up to here the window shows tokens in full length
        token = -1
        while at < n:
            if token < 0:  # a new place: the longest token from there; the search goes on where it stopped
                if at != seen or at > sure:
                    base, sure = at, n if n - at <= self.window else at + self.window - self.longest
                    ahead = longest(text[at : at + self.window])
                last, token = next(ahead)
                seen = base + last + 1
            before = out[-1] if out else -1
            while token >= 0:
                if may_end[at + size[token]]:
                    if before < 0:
                        break
                    pair = before << _SHIFT | token
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = self.apart(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = -1
            else:  # nothing leads on from here
                may_end[at] = 0
                token = out.pop()
                at -= size[token]
        return out


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain merging by rank, the definition; for short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, i = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == 1 << 62:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def _ranges(points: Iterable[int]) -> str:
    """The inside of a character class."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@functools.lru_cache(maxsize=2)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into the pieces that the tiktoken library finds by a pattern."""
    import regex
    import tiktoken

    usual = regex.compile(pattern)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    exact, odd = pattern, ""
    for name in ("L", "N"):
        if f"\\p{{{name}}}" not in pattern:
            continue
        probe = tiktoken.Encoding("probe", pat_str=f"\\p{{{name}}}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs = set(probe.decode(probe.encode_ordinary(every)))
        ours = set("".join(regex.findall(f"\\p{{{name}}}+", every)))
        odd += _ranges(map(ord, theirs ^ ours))
        # inside and outside of classes
        exact = exact.replace(f"\\p{{{name}}}", _ranges(map(ord, theirs)))
    if not odd:
        return usual.findall
    # bare classes become bracketed ones: what stood alone is in brackets now, what was in brackets stays there
    bare = re.compile(r"(?<!\[)(?<!\\s)(?<!\^)((?:\\U[0-9a-f]{8}-\\U[0-9a-f]{8})+)\+")
    slow = regex.compile(bare.sub(r"[\1]+", exact))
    told_apart = re.compile(f"[{odd}]")

    def cut(text: str) -> list[str]:
        return usual.findall(text) if text.isascii() or not told_apart.search(text) else slow.findall(text)

    return cut


class _Pieces(dict):
    """Ids of pieces, as little-endian unsigned 32-bit integers."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.automaton.encode(piece.encode("utf-8", "replace")), dtype="<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=1)
def _pieces(path: str) -> _Pieces:
    return _Pieces(Automaton(read_ranks(path)))


DROPS[__name__] = _pieces.cache_clear


def text_slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of at least ``SLICE`` bytes (the last may be shorter), each from a blank after a visible ASCII
    character on: no piece reaches over such a place. Text without one stays whole."""
    at = 0
    while len(text) - at > 2 * SLICE:
        place = _CUT.search(text, at + SLICE)
        end = place.start() if place else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _encode(path: str, pattern: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    pieces, cut = _pieces(path), splitter(pattern)
    for *kept, text in rows:
        ids = b"".join([b"".join(map(pieces.__getitem__, cut(decoded(part)))) for part in text_slices(text or b"")])
        yield *kept, len(ids) // 4, ids


def _decode(path: str, n: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    tokens = _pieces(path).automaton.tokens
    for row in rows:
        ids = row[n]
        if ids is None:
            yield *row, None
            continue
        # a slice of ids at a time, so that the list of tokens doesn't grow with the text
        parts = [b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4", offset=at, count=min(SLICE, len(ids) - at) // 4).tolist())) for at in range(0, len(ids) - len(ids) % 4, SLICE)]
        yield *row, b"".join(parts)


def _schema(df: DataFrame, keep: list[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), more])


def encode(docs: DataFrame, keep: list[str], vocabulary_path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, n_tokens and ids (little-endian unsigned 32-bit integers). One narrow pass. The
    vocabulary's path must exist on the executors."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = vocabulary_path or tokenizer_file(VOCABULARY)
    return map_rows(docs, [*[F.col(f"`{c}`") for c in keep], text_bytes(text_col)], functools.partial(_encode, path, pattern), _schema(docs, keep, "n_tokens long, ids binary"))


def decode(encoded: DataFrame, keep: list[str], vocabulary_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The columns ``keep``, the ids and ``decoded``, the bytes they stand for (null for null ids)."""
    path = vocabulary_path or tokenizer_file(VOCABULARY)
    ids = F.col(f"`{ids_col}`")
    return map_rows(encoded, [*[F.col(f"`{c}`") for c in keep], ids], functools.partial(_decode, path, len(keep)), _schema(encoded, keep, f"`{ids_col}` binary, decoded binary"))

"""Quality rules: how far a document's histograms lie from those of its nearest language.

References come from all documents: for each value of ``lang``, the counts of eight character classes and of the words
met most often. A document is compared with references by Jensen-Shannon distance (base 2, so from 0 to 1): once over
character classes, once over the common words with all other words as one more bin. It is kept if, for some language,
both distances are within their limits. Guards: a histogram from less than ``min_chars`` characters or ``min_words``
words isn't judged, and a language with fewer than ``reference_words`` words in all has no reference, whatever else is in
the table (with fewer, the histogram's own noise, some sqrt(48 / (8 n ln 2)), would pass 0.07). Documents of a language
without reference aren't judged by distance: only the base rules decide.

Each document is compared with all references, of which a block of some ``BROADCAST`` languages goes to all tasks at once, with
``COMMON`` words each. With more languages there are more blocks, each a pass that hands on what was nearest so far.

Two passes over the texts (one more for each further block). Words are counted within each task first; what is shuffled are sums. Repeated words and lines
are told by 64-bit hashes.

Null texts have no words and fail the base rules, as do empty ones. Null ``lang`` gives no reference but is judged like
others, by the nearest of all. Repeated rows count each time. Very long texts are taken apart in slices and
need some 40 bytes a word. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import decoded, map_rows, shared_dir, slices, stored, text_bytes, words

CLASSES = ("lower", "upper", "letter", "number", "space", "punctuation", "symbol", "other")
#: The characters that the base rules count as symbols.
SYMBOLS = b"#*$%&|<>"
COMMON = 48
#: Languages in a block of references, on average: a block goes to all tasks.
BROADCAST = 1000
#: Distinct words and languages that a task counts before it hands on; longer words are handed on at once.
HELD_WORDS = 200_000
HELD_LANGS = 10_000
LONG_WORD = 256
#: Words of which a worker remembers what they count as.
MEMO_WORDS = 200_000
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double, nearest string"
)


@functools.lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point of the basic plane; the last entry is for all beyond."""
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Z": 4, "L": 2, "M": 2, "N": 3, "P": 5, "S": 6}
    table = np.full(0x10001, 7, dtype=np.uint8)
    for cp in range(0x10000):
        category = unicodedata.category(chr(cp))
        table[cp] = kinds.get(category, kinds.get(category[0], 7))
    table[[9, 10, 11, 12, 13]] = 4
    table[list(SYMBOLS)] = 6
    table[[ord(c) for c in "@^_\\/~`"]] = 6
    return table


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(class_table()[np.minimum(points, 0x10000)], minlength=len(CLASSES))


def plain(word: bytes) -> bytes:
    """A word as it counts in histograms: A-Z lower-cased, without marks around it."""
    return word.lower().strip(b".,;:!?\"'()-")


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of histograms of any sums, along the last axis; 1 if one of the two is empty."""
    p, q = np.asarray(p, dtype=float), np.asarray(q, dtype=float)
    n, m = p.sum(axis=-1, keepdims=True), q.sum(axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / n, q / m
        mid = (p + q) / 2
        parts = np.where(p > 0, p * np.log2(p / mid), 0).sum(axis=-1) + np.where(q > 0, q * np.log2(q / mid), 0).sum(axis=-1)
    return np.where((n[..., 0] > 0) & (m[..., 0] > 0), np.sqrt(np.clip(parts / 2, 0, 1)), 1.0)


def repeated_words(hashes: np.ndarray) -> int:
    """Words, given by their hashes, that lie in a window of three words found at least twice."""
    h = hashes.astype(np.uint64)
    if len(h) < 4:
        return 0
    w = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    w = (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    s = np.sort(w)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    found = again[np.minimum(np.searchsorted(again, w), len(again) - 1)] == w
    inside = np.zeros(len(h), dtype=bool)
    for k in range(3):
        inside[k : len(h) - 2 + k] |= found
    return int(np.count_nonzero(inside))


def _lines(text: bytes) -> Iterator[list[bytes]]:
    """The text's lines, some at a time."""
    open_line: list[bytes] = []
    for part in slices(text):
        first, *rest = part.split(b"\n")
        open_line.append(first)
        if rest:
            yield [b"".join(open_line), *rest[:-1]]
            open_line = [rest[-1]]
    yield [b"".join(open_line)]


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    some = [np.fromiter((hash(x) for x in lines if x and not x.isspace()), dtype=np.int64) for lines in _lines(text)]
    told = np.concatenate(some)
    return len(told) - len(np.unique(told))


class _Places(dict):
    """What each word counts as: the place of its plain form among all common words, or the last place."""

    def __init__(self, common: list[bytes]):
        super().__init__()
        self.common = {w: i for i, w in enumerate(common)}

    def __missing__(self, word: bytes) -> int:
        place = self.common.get(plain(word), len(self.common))
        if len(word) <= LONG_WORD:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = place
        return place


@dataclass
class Counts:
    """What a text counts: words, their code points, symbols, repeated lines, words in repeated windows, classes of
    characters, and uses of each common word (others last)."""

    words: int
    chars: int
    symbols: int
    lines: int
    repeated: int
    classes: np.ndarray
    common: np.ndarray


def count(text: bytes, places: _Places) -> Counts:
    n = chars = symbols = 0
    classes, common = np.zeros(len(CLASSES), dtype=np.int64), np.zeros(len(places.common) + 1, dtype=np.int64)
    hashes = []
    for part in slices(text):
        found = words(part)
        n += len(found)
        chars += len(b"".join(found).decode("utf-8", "replace"))
        symbols += len(part) - len(part.translate(None, SYMBOLS))
        classes += class_counts(decoded(part))
        common += np.bincount(np.fromiter(map(places.__getitem__, found), dtype=np.int64, count=len(found)), minlength=len(common))
        hashes.append(np.fromiter(map(hash, found), dtype=np.int64, count=len(found)))
    return Counts(n, chars, symbols, repeated_lines(text), repeated_words(np.concatenate(hashes)), classes, common)


@dataclass
class References:
    """For each language its class counts and the counts of its common words, with all others last."""

    classes: dict[str, np.ndarray] = field(default_factory=dict)
    common: dict[str, dict[bytes, int]] = field(default_factory=dict)
    others: dict[str, int] = field(default_factory=dict)

    def add(self, lang: str, rows: list[tuple[str, str, int]], total: int) -> None:
        """``rows`` are (kind, name, count) of classes and common words."""
        by = {name: n for kind, name, n in rows if kind == "class"}
        self.classes[lang] = np.array([by.get(c, 0) for c in CLASSES])
        self.common[lang] = {name.encode(): n for kind, name, n in rows if kind == "word"}
        self.others[lang] = total - sum(self.common[lang].values())


@dataclass(frozen=True)
class Limits:
    char_distance: float = 0.28
    word_distance: float = 0.4
    min_chars: int = 100
    min_words: int = 100
    reference_words: int = 2000


def _count(rows: Iterator[tuple]) -> Iterator[tuple]:
    classes: dict[str, np.ndarray] = {}
    common: dict[str, Counter] = {}
    totals: Counter = Counter()

    def flush() -> Iterator[tuple]:
        for lang, counter in common.items():
            forms: Counter = Counter()
            for w, n in counter.items():
                forms[plain(w)] += n
            for w, n in forms.items():
                if w:
                    yield lang, "word", w.decode("utf-8", "replace"), n
        for lang, counts in classes.items():
            for name, n in zip(CLASSES, counts.tolist(), strict=True):
                yield lang, "class", name, n
            yield lang, "total", "", totals[lang]
        for held in (common, classes, totals):
            held.clear()

    held = 0
    for lang, text in rows:
        if lang is None or not text:
            continue
        own = common.setdefault(lang, Counter())
        before = len(own)
        for part in slices(text):
            counts = class_counts(decoded(part))
            classes[lang] = classes[lang] + counts if lang in classes else counts
            found = words(part)
            totals[lang] += len(found)
            own.update(found)
            if len(part) > LONG_WORD and len(max(found, key=len, default=b"")) > LONG_WORD:
                for w in [w for w in own if len(w) > LONG_WORD]:
                    n = own.pop(w)
                    if form := plain(w):
                        yield lang, "word", form.decode("utf-8", "replace"), n
        held += len(own) - before
        if held > HELD_WORDS or len(classes) > HELD_LANGS:
            yield from flush()
            held = 0
    yield from flush()


def _tops(docs: DataFrame, limits: Limits, common: int) -> tuple[DataFrame, DataFrame]:
    """Languages that have a reference (lang, total); rows (lang, kind, name, n) of all languages. Both are stored."""
    at = shared_dir(docs.sparkSession)
    counted = map_rows(docs, [F.col("lang").cast("string"), text_bytes()], _count, "lang string, kind string, name string, n long")
    # a word's counts meet first under its own key, so no language's words meet in one task before they are few
    sums = counted.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), F.col("name"))
    top = stored(sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= common).drop("place"), f"{at}/top")
    total = F.sum(F.when(F.col("kind") == "total", F.col("n")))
    chars = F.sum(F.when(F.col("kind") == "class", F.col("n")))
    langs = top.groupBy("lang").agg(total.alias("total"), chars.alias("chars")).filter((F.col("total") >= max(1, limits.reference_words)) & (F.col("chars") >= limits.min_chars))
    return stored(langs.select("lang", "total"), f"{at}/langs"), top


def blocks(docs: DataFrame, common: int = COMMON, limits: Limits | None = None) -> Iterator[References]:
    """Learn the references of all languages that pass the guards from all documents; in blocks, by the hash of the language,
    each checked against twice its usual size (without languages one empty block)."""
    langs, top = _tops(docs, limits or Limits(), common)
    n = max(1, -(-langs.count() // BROADCAST))
    for block in range(n):
        refs = References()
        sent = langs.filter(F.pmod(F.xxhash64("lang"), F.lit(n)) == block).limit(2 * BROADCAST + 50)
        totals = {r.lang: r.total for r in sent.collect()}
        if len(totals) == 2 * BROADCAST + 50:
            raise RuntimeError("a block of languages is larger than its bound")
        by: dict[str, list[tuple[str, str, int]]] = {}
        for r in top.join(F.broadcast(sent), "lang").collect():
            by.setdefault(r.lang, []).append((r.kind, r["name"], r.n))
        for lang in sorted(totals):
            refs.add(lang, by[lang], totals[lang])
        yield refs


def references(docs: DataFrame, common: int = COMMON, limits: Limits | None = None) -> References:
    """The references of a table of at most ``BROADCAST`` languages; of more, ``blocks`` are to be used."""
    first, *more = blocks(docs, common, limits)
    if more:
        raise ValueError(f"more than {BROADCAST} languages have references")
    return first


class Nearest:
    """Distances of a text's counts to all of some references at once."""

    def __init__(self, refs: References, limits: Limits):
        self.limits, self.langs = limits, list(refs.classes)
        self.places = _Places(sorted({w for c in refs.common.values() for w in c}))
        width = max([len(c) for c in refs.common.values()], default=0)
        none = len(self.places.common)
        self.classes = np.array([refs.classes[x] for x in self.langs]).reshape(-1, len(CLASSES))
        # a language with fewer common words than others is filled up with a place that is never used
        self.at = np.full((len(self.langs), width), none, dtype=np.int64)
        self.want = np.zeros((len(self.langs), width + 1))
        for i, lang in enumerate(self.langs):
            for k, (w, n) in enumerate(refs.common[lang].items()):
                self.at[i, k], self.want[i, k] = self.places.common[w], n
            self.want[i, -1] = refs.others[lang]

    def distances(self, c: Counts) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Of classes and of common words, to each language; None where a guard holds."""
        by_class = jensen_shannon(c.classes, self.classes) if c.classes.sum() >= self.limits.min_chars else None
        if c.words < self.limits.min_words:
            return by_class, None
        uses = c.common.copy()
        uses[-1] = 0
        own = np.empty(self.want.shape)
        own[:, :-1] = uses[self.at]
        own[:, -1] = c.words - own[:, :-1].sum(axis=1)
        return by_class, jensen_shannon(own, self.want)

    def best(self, c: Counts) -> tuple[float, str, float | None, float | None] | None:
        """How far the nearest language goes beyond its limits (1 is the limit), that language and both distances."""
        if not self.langs:
            return None
        by_class, by_word = self.distances(c)
        none = np.zeros(len(self.langs))
        over = np.maximum(none if by_class is None else by_class / self.limits.char_distance, none if by_word is None else by_word / self.limits.word_distance)
        i = int(over.argmin())
        return float(over[i]), self.langs[i], None if by_class is None else float(by_class[i]), None if by_word is None else float(by_word[i])


BEST = "over: double, nearest: string, char_distance: double, word_distance: double, referenced: boolean"


def _nearest(sent: Nearest, c: Counts, lang: str | None, before: dict | None) -> tuple:
    """The nearest language so far (of equals the first by name) with how far it goes beyond its limits and both distances,
    and whether the document's own language has a reference."""
    found = [x for x in ((before["over"], before["nearest"], before["char_distance"], before["word_distance"]) if before and before["nearest"] is not None else None, sent.best(c)) if x]
    best = min(found, key=lambda x: x[:2], default=(None,) * 4)
    return *best, bool(before and before["referenced"]) or lang in sent.langs


def _compare(refs: References, limits: Limits, rows: Iterator[tuple]) -> Iterator[tuple]:
    """A block before the last: rows go on with what was nearest so far."""
    sent = Nearest(refs, limits)
    for doc_id, lang, text, before in rows:
        yield doc_id, lang, text, *_nearest(sent, count(text or b"", sent.places), lang, before)


def _judge(refs: References, limits: Limits, rows: Iterator[tuple]) -> Iterator[tuple]:
    sent = Nearest(refs, limits)
    for doc_id, lang, text, before in rows:
        c = count(text or b"", sent.places)
        failed = c.words < 50 or 100 * c.repeated > 50 * c.words
        over, nearest, by_class, by_word, referenced = _nearest(sent, c, lang, before)
        if lang is not None and not referenced:
            over = nearest = by_class = by_word = None
        kept = not failed and (over is None or over <= 1)
        yield doc_id, c.words, c.chars, c.symbols, c.lines, c.repeated, failed, kept, by_class, by_word, nearest


def judge(docs: DataFrame, refs: References | None = None, limits: Limits | None = None) -> DataFrame:
    """One row per document: base counts, verdict, both distances to the nearest language and that language; null
    distances where the document's language has no reference."""
    limits = limits or Limits()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_bytes().alias("text"), F.lit(None).cast(f"struct<{BEST}>").alias("before"))
    columns = [F.col(c) for c in ("doc_id", "lang", "text", "before")]
    known = iter([refs]) if refs is not None else blocks(docs, COMMON, limits)
    last = next(known)
    for block in known:  # the driver holds two at a time
        last, this = block, last
        told = map_rows(rows, columns, functools.partial(_compare, this, limits), f"doc_id long, lang string, text binary, {BEST.replace(':', '')}")
        rows = stored(told.select("doc_id", "lang", "text", F.struct(*[p.split(":")[0] for p in BEST.split(", ")]).alias("before")))
    return map_rows(rows, columns, functools.partial(_judge, last, limits), SCHEMA)

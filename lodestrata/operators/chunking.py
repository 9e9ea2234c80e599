"""Chunking: one text to many pieces, by expressions that stay within the JVM.

Packing folds the pieces of one text from left to right, so it never looks across rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_list


def lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")


def paragraphs(t: Column) -> Column:
    """Blank-line separated parts, trimmed; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(t, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(t)))


def sentences(t: Column) -> Column:
    return F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def pages(t: Column) -> Column:
    return F.filter(F.split(t, r"(?m)^--- Page[^\n]*\n?"), lambda x: F.trim(x) != "")


def pack(parts: Column, limit: int = 512, sep: str = "\n\n", overlap_words: int = 0) -> Column:
    """Greedy packing: a part joins the open chunk while the chunk stays within the limit, else it opens the next, which
    begins with the last words of the one before if ``overlap_words`` is set. No part is lost or cut."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc["open"]) + len(sep) + F.length(part) <= limit
        after = part
        if overlap_words:
            tail = F.array_join(F.slice(word_list(acc["open"]), F.greatest(F.lit(1), F.size(word_list(acc["open"])) - overlap_words + 1), F.lit(overlap_words)), " ")
            after = F.concat(tail, F.lit(sep), part)
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), part.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(sep), part).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), after.alias("open")))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def fixed(t: Column, size: int = 512) -> Column:
    """Pieces of ``size`` characters; all of the text is kept."""
    n = F.ceil(F.length(t) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def exploded(df: DataFrame, key: list[str], parts: Column, piece: str = "piece") -> DataFrame:
    return df.select(*key, F.posexplode(parts).alias("idx", piece))


def offset(t: Column, piece: Column) -> Column:
    """Where a piece is first met in its text, from 0; -1 if it isn't part of it. ``spans`` tell the place of each piece."""
    return F.position(piece, t) - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(t: Column, between: str) -> Column:
    """Trimmed parts of a text with their places: array of (start, piece), blank parts left out. ``between`` is a pattern of
    what parts them and never matches nothing."""
    cut = F.arrays_zip(F.split(t, between, -1).alias("part"), F.regexp_extract_all(t, F.lit(between), F.lit(0)).alias("gap"))
    none = F.array().cast("array<struct<start:int,piece:string>>")

    def step(acc: Column, x: Column) -> Column:
        piece = F.trim(x["part"])
        start = acc["at"] + F.length(x["part"]) - F.length(F.ltrim(x["part"]))
        found = F.when(piece != "", F.array(F.struct(start.alias("start"), piece.alias("piece")))).otherwise(none)
        return F.struct((acc["at"] + F.length(x["part"]) + F.coalesce(F.length(x["gap"]), F.lit(0))).alias("at"), F.concat(acc["out"], found).alias("out"))

    return F.aggregate(cut, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def paragraph_spans(t: Column) -> Column:
    return spans(t, r"\n\s*\n")


def line_spans(t: Column) -> Column:
    return spans(t, "\n")


def pack_spans(parts: Column, limit: int = 512, sep: str = "\n\n", overlap_words: int = 0) -> Column:
    """``pack`` for parts with places: array of (start, stop, text). A piece's own text begins at ``start`` and its last part
    ends before ``stop``; the words it repeats from the piece before, if any, come ahead of that and have no place."""
    piece = "struct<start:int,stop:int,text:string>"
    start = F.struct(F.array().cast(f"array<{piece}>").alias("done"), F.lit(None).cast(piece).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["open"]
        stop = x["start"] + F.length(x["piece"])
        fits = F.length(held["text"]) + len(sep) + F.length(x["piece"]) <= limit
        text = x["piece"]
        if overlap_words:
            words = word_list(held["text"])
            tail = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - overlap_words + 1), F.lit(overlap_words)), " ")
            text = F.when(held.isNull(), text).otherwise(F.concat(tail, F.lit(sep), text))
        fresh = F.struct(x["start"].alias("start"), stop.alias("stop"), text.alias("text"))
        longer = F.struct(held["start"].alias("start"), stop.alias("stop"), F.concat(held["text"], F.lit(sep), x["piece"]).alias("text"))
        grown = ~held.isNull() & fits
        done = F.when(held.isNull() | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(held)))
        return F.struct(done.alias("done"), F.when(grown, longer).otherwise(fresh).alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


# How the sections that head an entity's card begin, or what they hold.
HEADERS = r"^(?:Item:|Recipe:|Mob:)|Key:"


def _n_words(t: Column) -> Column:
    return F.size(word_list(t))


def _windows(t: Column, n: Column) -> Column:
    """A text in pieces of ``n`` words."""
    return _let(word_list(t), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / n).cast("int")), lambda i: F.array_join(F.slice(w, i * n + 1, n), " ")))


def _counted(parts: Column) -> Column:
    """Parts with their words, which are counted once: array of (part, n)."""
    return F.transform(parts, lambda x: F.struct(x.alias("part"), _n_words(x).alias("n")))


def _units(body: Column, budget: Column) -> Column:
    """Sections within the budget, with their words; a longer one in its paragraphs, a longer paragraph in pieces of as many
    words."""
    small = lambda x, rest: F.when(x["n"] <= budget, F.array(x)).otherwise(rest)
    pieces = lambda p: small(p, _counted(_windows(p["part"], budget)))
    return F.flatten(F.transform(_counted(body), lambda s: small(s, F.flatten(F.transform(_counted(paragraphs(s["part"])), pieces)))))


def entity_split(t: Column, max_words: int = 800) -> Column:
    """An entity's card of over ``max_words`` words in pieces of at most so many, each with the card's header ahead of it.

    Sections end at ``---`` lines and before ``##`` headings, else at blank lines. The header is the leading sections that
    name the entity, else the first section; if it takes over half of the words, the card's first line stands for it, if that
    is short enough. Sections are packed up to what the header leaves; none is lost."""
    by_rule = F.filter(F.transform(F.split(t, r"(?m)^(?:---+\s*$|(?=##\s))"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    sections = _let(by_rule, lambda x: F.when(F.size(x) > 1, x).otherwise(paragraphs(t)))
    half = max_words // 2
    packed = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def pieces(head: Column, body: Column) -> Column:
        def packed_to(budget: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                fits = acc["open"].isNotNull() & (acc["n"] + x["n"] <= budget)
                grown = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n"), x["part"]).alias("open"), (acc["n"] + x["n"]).alias("n"))
                closed = F.struct(F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), x["part"].alias("open"), x["n"].alias("n"))
                return F.when(fits, grown).otherwise(closed)

            return F.aggregate(_units(body, budget), packed, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))

        out = _let(F.lit(max_words) - F.when(head == "", 0).otherwise(_n_words(head)), packed_to)
        return F.transform(out, lambda x: F.when(head == "", x).otherwise(F.concat(head, F.lit("\n\n"), x)))

    def split(s: Column) -> Column:
        def parted(n: Column) -> Column:
            whole = F.array_join(F.slice(s, F.lit(1), n), "\n")
            line = F.trim(F.substring_index(F.element_at(s, 1), "\n", 1))
            first = F.when(_n_words(line) <= half, line).otherwise("")
            fitting = F.struct(whole.alias("head"), F.slice(s, n + 1, F.greatest(F.size(s) - n, F.lit(0))).alias("body"))
            return F.when((F.size(s) > n) & (_n_words(whole) <= half), fitting).otherwise(F.struct(first.alias("head"), s.alias("body")))

        other = F.array_position(F.transform(s, lambda x: ~x.rlike(HEADERS)), True).cast("int")
        heads = _let(other, lambda o: F.greatest(F.lit(1), F.when(o > 0, o - 1).otherwise(F.size(s) - 1)))
        return _let(_let(heads, parted), lambda x: pieces(x["head"], x["body"]))

    return F.when(_n_words(t) > max_words, _let(sections, split)).otherwise(F.array(t))

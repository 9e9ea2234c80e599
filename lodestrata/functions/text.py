"""Text expressions: words, squeezing, hashes, ids, trigrams, versions, durations, HTML."""

from __future__ import annotations

import html.entities
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_list(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(word_list(t)).cast("long")


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def content_hash(t: Column) -> Column:
    return F.sha2(t, 256)


def bag_hash(item: Column) -> Column:
    """Aggregate: 12 hexadecimal digits that tell a group's items whatever their order, as the sum of their hashes; tasks
    send sums. Null items don't count."""
    one = F.conv(F.left(F.sha2(item, 256), F.lit(12)), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(one), F.lit(0).cast("decimal(30,0)"))
    return F.lower(F.lpad(F.hex(F.pmod(total, F.lit(1 << 48).cast("decimal(20,0)")).cast("long")), 12, "0"))


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat_ws("::", source.cast("string"), F.lit("chunk"), index.cast("string"))


def entity_id(kind: Column, name: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(".", kind, name), 256), F.lit(32))


def trigrams(t: Column) -> Column:
    """Distinct trigrams of the lower-cased text with two blanks before and one after."""
    padded = F.concat(F.lit("  "), F.lower(t), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def semver(v: Column) -> Column:
    """A sortable struct of a version like v1.2.3-beta.4: a release is above its pre-releases; null if it isn't one."""
    part = lambda k: F.regexp_extract(v, r"^[vV]?(\d+)\.(\d+)\.(\d+)(?:-([A-Za-z]+)[.]?(\d*))?", k)
    number = lambda k: F.when(part(k) != "", part(k).cast("int"))
    label = F.lower(part(4))
    rank = F.when(label == "", 4).when(label == "rc", 3).when(label == "beta", 2).when(label == "alpha", 1).otherwise(0)
    return F.when(number(1).isNotNull(), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), rank.alias("stage"), F.coalesce(number(5), F.lit(0)).alias("build")))


def bump(v: Column, part: str) -> Column:
    """The next major, minor or patch version."""
    s = semver(v)
    numbers = {"major": (s.major + 1, F.lit(0), F.lit(0)), "minor": (s.major, s.minor + 1, F.lit(0)), "patch": (s.major, s.minor, s.patch + 1)}
    return F.concat_ws(".", *[n.cast("string") for n in numbers[part]])


def duration(ms: Column) -> Column:
    """Milliseconds as 450ms, 12.3s, 4m 05s or 2h 03m."""
    s = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.format_string("%dms", ms.cast("long")))
        .when(ms < 60_000, F.format_string("%.1fs", ms / 1000))
        .when(ms < 3_600_000, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def bar(share: Column, width: int = 20) -> Column:
    full = F.least(F.greatest(F.round(share * width), F.lit(0)), F.lit(width)).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def whole_json(t: Column) -> Column:
    """The JSON value that a text is; null for others. Spark's parser reads the first value and leaves what follows, so the text
    is also put into an array and an object: what may follow a value in one of them may not in the other."""
    within = [F.try_parse_json(F.concat(F.lit(a), t, F.lit(b))) for a, b in (("[", "]"), ('{"v":', "}"))]
    return F.when(within[0].isNotNull() & within[1].isNotNull(), F.try_parse_json(t))


def prose(t: Column, limit: int = 3000, json: bool = True) -> Column:
    """JSON texts in compact form (unless told that there are none), others as they are, cut at the limit."""
    return F.left(F.coalesce(F.to_json(whole_json(t)), t) if json else t, F.lit(limit))


# --- HTML ---
#: Named entities by the standard library's table of HTML 4, with a plain blank for the one that doesn't break.
ENTITIES = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def unescaped(t: Column) -> Column:
    """The text with its character references (named as in HTML 4, decimal, hexadecimal) read. What isn't one stays as it
    is. The names are a literal of the plan, so the longer table of HTML 5 isn't used."""
    return bound(t, lambda x: F.when(x.contains("&"), bound(F.split(x, "&"), _read_references)).otherwise(x))


def _read_references(parts: Column) -> Column:
    """The text whose parts begin behind ampersands, but for the first."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    # each step is its own pass, so that an expression of it is computed once: the reference, its character, the text
    refs = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(p.alias("part"), F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1).alias("ref")))
    code = lambda r: F.when(F.lower(r).startswith("#x"), F.conv(F.substring(r, 3, 8), 16, 10)).when(r.startswith("#"), F.substring(r, 2, 8)).cast("long")
    coded = F.transform(refs, lambda x: F.struct(x["part"].alias("part"), x["ref"].alias("ref"), code(x["ref"]).alias("code")))
    valid = lambda c: (c > 0) & (c < 0x110000) & ~c.between(0xD800, 0xDFFF)
    char = lambda x: F.when(x["ref"] == "", None).when(x["code"].isNull(), F.try_element_at(names, x["ref"])).when(valid(x["code"]), F.decode(F.unhex(F.lpad(F.hex(x["code"]), 8, "0")), "UTF-32"))
    told = F.transform(coded, lambda x: F.struct(x["part"].alias("part"), x["ref"].alias("ref"), char(x).alias("char")))
    read = lambda x: F.when(x["char"].isNull(), F.concat(F.lit("&"), x["part"])).otherwise(F.concat(x["char"], F.substr(x["part"], F.length(x["ref"]) + 2)))
    return F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(told, read)), "")


def html_text(h: Column) -> Column:
    """Visible text: scripts, styles and comments go, breaks and paragraphs become lines, other tags blanks, so words of
    neighbouring cells and blocks stay apart. Character references are read last."""
    t = F.regexp_replace(h, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</?p(?:\s[^>]*)?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(unescaped(t), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def html_title(h: Column, default: str = "Untitled") -> Column:
    t = squeeze(unescaped(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(t == "", F.lit(default)).otherwise(t)


def html_hrefs(h: Column) -> Column:
    """Link targets as written, in order."""
    return F.regexp_extract_all(h, F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"']+)[\"']"), 1)


def html_links(url: Column, h: Column) -> Column:
    """Absolute http links of a page in order, without query and fragment, each once."""
    full = F.transform(html_hrefs(h), lambda x: absolute(url, F.regexp_replace(x, r"[?#].*$", "")))
    return F.array_distinct(F.filter(full, lambda x: x.rlike(r"^https?://[^/]")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def tidy_path(p: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(p, "/"), empty,
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(p.contains("/."), F.array_join(parts, "/")).otherwise(p)


def absolute(url: Column, href: Column) -> Column:
    """The target of a link on a page: absolute, protocol-relative, site-relative or relative to the page's folder. Links of
    another scheme stay as they are; an empty one is the page."""
    scheme = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    site = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_replace(path(url), r"[^/]*$", "")
    return (
        F.when(href == "", F.concat(site, path(url)))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, tidy_path(href)))
        .otherwise(F.concat(site, tidy_path(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), href))))
    )


def is_url(t: Column) -> Column:
    return t.rlike(r"^https?://[a-zA-Z0-9]")


#: What a challenge page holds instead of its content.
CHALLENGES = ["just a moment", "/cdn-cgi/challenge-platform"]


def is_challenge(h: Column) -> Column:
    t = F.lower(h)
    out = F.lit(False)
    for mark in CHALLENGES:
        out = out | t.contains(mark)
    return out

"""URL filters: fixed rules first, then association rules that FP-growth mines from labelled URLs.

Host and path are cut out of the URL as given. A fixed rule fits its host and all subdomains if the path starts with the
rule's path; the longest fitting rule decides. For all other URLs, tokens (domain labels, path parts, words in either)
of labelled URLs are mined together with their label. A set of tokens whose confidence for *bad* and whose support reach
their limits, and none of whose parts is a rule already, becomes a rule; a URL that holds all tokens of a rule is
blocked. Rules are kept as an inverted index from each rule's rarest token, so a URL looks up its own tokens and not
all rules.

FP-growth runs in Spark over the labelled URLs; tokens below the support limit (page numbers, most names) go first, and
are counted with partial sums. Rules may have any number of tokens. They are sent to all tasks if they are at most
``MAX_BROADCAST_RULES``; beyond that the index is joined in a shuffle, by each rule's rarest token, in chunks of
``CHUNK_RULES``, with common tokens as heavy keys. Urls without a rule's token are allowed, as are all if nothing was
mined.

A null or empty url, or one without ``://``, has empty host and path and is judged by its tokens, of which it has none: it
is allowed. Labels that are null don't count. Repeated rows are judged each for itself. Very long urls are judged whole.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, map_rows, stored

#: Rule text (host/path) and verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
MAX_BROADCAST_RULES = 10_000
CHUNK_RULES = 100
BAD = "\x01bad"


@dataclass(frozen=True)
class Limits:
    """support: share of the labelled URLs; rows: the least number of them; confidence: share of those that are bad."""

    support: float = 0.002
    rows: int = 20
    confidence: float = 0.8


def host(url: Column) -> Column:
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: dict[str, str] | None = None) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for rule in sorted(RULES if rules is None else rules, key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def verdict_of(rule: Column, rules: dict[str, str] | None = None) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in (RULES if rules is None else rules).items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens, marked by where they stand: labels of the host and their words, parts of the path and theirs."""
    labels = F.split(host, r"[.:@]")
    parts = F.split(F.lower(path), "/")
    words = lambda x: F.split(x, r"[-_.~%+,;=]")
    marked = lambda mark, x: F.transform(F.filter(x, lambda t: t != ""), lambda t: F.concat(F.lit(mark), t))
    return F.array_distinct(F.concat(marked("h:", labels), marked("hw:", F.flatten(F.transform(labels, words))), marked("p:", parts), marked("pw:", F.flatten(F.transform(parts, words)))))


def mine(labelled: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Rules from rows (url, bad boolean): items (the rule's tokens), confidence, support; stored."""
    limits = limits or Limits()
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("url").isNotNull() & F.col("bad").isNotNull()).select("bad", tokens(host(F.col("url")), path(F.col("url"))).alias("items"))
    rows = stored(rows)
    total = rows.count()
    least = max(limits.rows, limits.support * total)
    # a token below the least count is in no rule; what stays has at most tokens-per-URL / support members
    often = rows.select(F.explode("items").alias("t")).groupBy("t").count().filter(F.col("count") >= least)
    often = sorted(r.t for r in often.collect())
    empty = spark.createDataFrame([], "items array<string>, confidence double, support double")
    if not often or total < least:
        return empty
    kept = F.concat(F.array_intersect("items", F.array(*[F.lit(t) for t in often])), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    # half a row less, so that rounding can't ask for one row more; urls without a frequent token count as rows too
    growth = FPGrowth(itemsCol="items", minSupport=(math.ceil(least) - 0.5) / total, minConfidence=limits.confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = growth.fit(rows.select(kept.alias("items"))).associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    return least_rules(stored(found.select(F.array_sort("antecedent").alias("items"), "confidence", "support")))


def rarest(rules: DataFrame) -> DataFrame:
    """The rules with ``key``, the token that the fewest rules hold."""
    spread = rules.select("items", F.explode("items").alias("key"))
    uses = spread.groupBy("key").agg(F.count("*").alias("uses"))
    first = spread.join(uses, "key").groupBy("items").agg(F.min(F.struct("uses", "key")).alias("first"))
    return first.select("items", F.col("first.key").alias("key"))


def least_rules(rules: DataFrame) -> DataFrame:
    """The rules none of whose proper parts is a rule: each rule looks up, by its tokens, those kept under their rarest."""
    parts = rarest(rules).withColumnRenamed("items", "part")
    met = rules.select("items", F.explode("items").alias("key")).join(parts, "key").filter(F.size("part") < F.size("items"))
    covered = met.filter(F.size(F.array_except("part", "items")) == 0).select("items").distinct()
    return rules.join(covered, "items", "left_anti")


def build_index(rules: list[list[str]]) -> dict[str, list[frozenset[str]]]:
    """Each rule under its token that the fewest rules hold."""
    uses: dict[str, int] = {}
    for rule in rules:
        for t in rule:
            uses[t] = uses.get(t, 0) + 1
    index: dict[str, list[frozenset[str]]] = {}
    for rule in rules:
        index.setdefault(min(rule, key=lambda t: (uses[t], t)), []).append(frozenset(rule))
    return index


def _match(index: dict[str, list[frozenset[str]]], rows: Iterator[tuple]) -> Iterator[tuple]:
    for page_id, host, path, rule, verdict, items in rows:
        if verdict is None:
            own = set(items)
            verdict = "block" if any(r <= own for t in own for r in index.get(t, ())) else "allow"
        yield page_id, host, path, rule, verdict


def judge(pages: DataFrame, rules: DataFrame, fixed: dict[str, str] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    schema = "page_id long, host string, path string, rule string, verdict string"
    url = F.col("url").cast("string")
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    cut = cut.withColumn("rule", fixed_rule(F.col("host"), F.col("path"), fixed))
    cut = cut.withColumn("verdict", verdict_of(F.col("rule"), fixed)).withColumn("items", F.when(F.col("verdict").isNull(), tokens(F.col("host"), F.col("path"))))
    some = rules.select("items").limit(MAX_BROADCAST_RULES + 1).collect()
    if len(some) <= MAX_BROADCAST_RULES:
        index = build_index([r["items"] for r in some])
        return map_rows(cut, [F.col(c) for c in cut.columns], functools.partial(_match, index), schema)
    keyed = stored(cut.withColumn("__row", F.monotonically_increasing_id()))
    spread = keyed.filter(F.col("verdict").isNull()).select("__row", "items", F.explode("items").alias("key"))
    index = stored(rarest(rules))
    chunks = index.groupBy("key").agg(F.ceil(F.count("*") / CHUNK_RULES).cast("long").alias("chunks"))
    # tokens of the index that pages hold, with the pages that do
    held = stored(spread.groupBy("key").agg(F.count("*").alias("pages")).join(chunks, "key"))
    asked = keyed_join(spread, held, "key", "pages", ["chunks"]).filter(F.col("chunks").isNotNull())
    chunk = lambda k: F.concat("key", F.lit("\x02"), k.cast("string"))
    asked = asked.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("__row", "items", chunk(F.col("__k")).alias("chunk"))
    dealt = index.join(held, "key").select(chunk(F.pmod(F.xxhash64("items"), F.col("chunks"))).alias("chunk"), "pages", F.col("items").alias("need"))
    lists = stored(dealt.groupBy("chunk").agg(F.first("pages").alias("pages"), F.collect_list("need").alias("needs")))
    hit = keyed_join(asked, lists, "chunk", "pages", ["needs"]).filter(F.exists("needs", lambda need: F.size(F.array_except(need, F.col("items"))) == 0))
    out = keyed.join(hit.select("__row").distinct().withColumn("__hit", F.lit("block")), "__row", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "__hit", F.lit("allow")).alias("verdict"))

"""Link graphs: edges, histograms, breadth-first crawls with depth and page budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, stored
from .windows import latest


def edges(rows: DataFrame, src: str, targets: str, dst: str = "dst") -> DataFrame:
    return rows.select(F.col(src).alias("src"), F.explode(targets).alias(dst))


def histogram(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by)


def touching(links: DataFrame, category: str | None = None, name: str | None = None, link_type: str | None = None) -> DataFrame:
    """Links by category, by name on either end, and by type; strongest first."""
    if category:
        links = links.filter(F.col("source_category") == category)
    if name:
        links = links.filter((F.col("source_name") == name) | (F.col("target_name") == name))
    if link_type:
        links = links.filter(F.col("link_type") == link_type)
    return links.orderBy(F.col("confidence").desc_nulls_last(), "source_category", "source_name")


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int, per_page: int | None = None) -> DataFrame:
    """Nodes that seeds reach within ``max_depth`` links, with their least depth. ``links`` has src, dst and pos; the
    first ``per_page`` of each page are followed. One join per level; visited nodes go by anti join. Links and levels are
    stored, so neither pages are parsed nor earlier levels made again."""
    if per_page is not None:
        links = latest(links, ["src"], [F.col("pos"), F.col("dst")], per_page)
    at = shared_dir(seeds.sparkSession)
    links = stored(links.select("src", "dst").distinct(), f"{at}/links")
    seen = frontier = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)), f"{at}/0")
    for depth in range(1, max_depth + 1):
        step = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), f"{at}/{depth}")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def same_host(links: DataFrame) -> DataFrame:
    """Links that stay on their page's host; nodes are host and path."""
    site = lambda c: F.substring_index(c, "/", 1)
    return links.filter(site("src") == site("dst"))


def budget(visited: DataFrame, pages: int, by: list[str] | None = None) -> DataFrame:
    """The first pages of a crawl by depth, then name: of all, or of each group."""
    return latest(visited, by, [F.col("depth"), F.col("node")], pages) if by else visited.orderBy("depth", "node").limit(pages)


def crawl_stats(visited: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Pages, deepest level, pages per level and failures of a crawl, in one row."""
    by = visited.groupBy("depth").agg(F.count("*").alias("n"))
    out = by.agg(F.sum("n").alias("pages"), F.max("depth").alias("max_depth"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("depth", "n")))).alias("by_depth"))
    n = F.lit(0).cast("long") if failed is None else F.lit(failed.count())
    return out.withColumn("failed", n)


def typed_edges(rows: DataFrame, category: str, name: str, targets: str, target_category: str, link_type: str, confidence: float | Column = 1.0) -> DataFrame:
    """Links from each row to the names in its list, as stored link rows without repeats."""
    return rows.select(
        F.lit(category).alias("source_category"), F.col(name).alias("source_name"), F.lit(target_category).alias("target_category"),
        F.explode(targets).alias("target_name"), F.lit(link_type).alias("link_type"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"),
    ).distinct()


def class_links(classes: DataFrame, known: str = "name", types: str = "types") -> DataFrame:
    """Links from classes to the known classes that their types name, by base name without arrays, packages and generics."""
    base = F.regexp_replace(F.regexp_replace("t", r"<.*$|\[\]", ""), r"^.*\.", "")
    used = classes.select(F.col(known).alias("src"), F.explode(types).alias("t")).select("src", base.alias("dst")).distinct()
    return used.join(classes.select(F.col(known).alias("dst")).distinct(), "dst", "left_semi").filter("src <> dst").select("src", "dst")

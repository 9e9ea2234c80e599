"""Package trees: numeric folders with a manifest, script members routed to collections, checks of manifests and logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..config import SKIPPED_EXTENSIONS
from ..operators import chunking
from . import extract
from .files import extension, folder_id, key_values, texts

# Kinds of package files by extension, and of further ones that this engine reads too.
MEMBER_COLLECTIONS = {"lua": "scripts", "bin": "configs", "cfg": "configs", "pbo": "configs", "pbosync": "configs"}
MORE_COLLECTIONS = {"zip": "configs", "xml": "configs", "ini": "configs", "md": "guides"}
# Manifest fields and folders a package must have, patterns of log errors.
REQUIRED_FIELDS = ["id", "name", "description"]
EXPECTED_FOLDERS = ["media", "media/lua"]
LOG_ERRORS = {"stack trace": r"(?i)stack trace", "exception": r"(?i)\bexception\b", "missing file": r"(?i)no such file|file not found", "script error": r"(?i)\berror\b.*\.lua"}
NATIVE_CHARS: int | None = 50_000


@F.pandas_udf(MapType(StringType(), StringType()))
def manifest(text: pd.Series) -> pd.Series:
    return text.map(lambda t: key_values(t or ""))


def packages(files: DataFrame) -> DataFrame:
    """package, name, author, tags, n_files and n_bytes per numeric folder. The manifest gives the name, else a README's
    first line, else the folder."""
    mine = files.withColumn("package", folder_id(F.col("path"))).filter(F.col("package").isNotNull())
    totals = mine.groupBy("package").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
    low = F.lower("path")
    heads = texts(mine.filter(low.endswith("/addoninfo.txt") | low.endswith("/mod.info") | low.rlike(r"/readme(\.[a-z]+)?$")))
    told = heads.withColumn("info", F.when(F.lower("path").rlike("readme"), F.create_map(F.lit("readme"), F.element_at(F.split(F.trim("text"), "\n"), 1))).otherwise(manifest("text")))
    one = told.groupBy("package").agg(*[F.max(F.try_element_at("info", F.lit(k))).alias(k) for k in ("name", "title", "author", "description", "tags", "version", "readme")])
    out = totals.join(one, "package", "left")
    name = F.coalesce("name", "title", F.regexp_replace("readme", r"^#+\s*", ""), "package")
    return out.select("package", name.alias("name"), "author", "description", "version", F.when(F.col("tags").isNotNull(), F.split("tags", r"\s*[;,]\s*")).alias("tags"), "n_files", "n_bytes")


def find(found: DataFrame, package: str) -> DataFrame:
    return found.filter(F.col("package") == package)


def ingest(files: DataFrame, limit: int = 512) -> tuple[DataFrame, DataFrame]:
    """Chunks of all text members with their package and collection, and per package the chunks, errors and success."""
    mine = files.filter(folder_id(F.col("path")).isNotNull())
    parsed = extract.records(mine)
    routes = F.create_map(*[F.lit(x) for p in (MEMBER_COLLECTIONS | MORE_COLLECTIONS).items() for x in p])
    rows = extract.chunks(parsed, limit).withColumn("package", folder_id(F.col("source"))).withColumn("collection", F.coalesce(F.try_element_at(routes, extension(F.col("source"))), F.lit("guides")))
    failed = parsed.filter("error is not null").groupBy(folder_id(F.col("source")).alias("package")).agg(F.count("*").alias("n_errors"))
    made = rows.groupBy("package").agg(F.count("*").alias("n_chunks"))
    result = mine.select(folder_id(F.col("path")).alias("package")).distinct().join(made, "package", "left").join(failed, "package", "left").na.fill(0, ["n_chunks", "n_errors"])
    return rows, result.withColumn("success", F.col("n_chunks") > 0)


def native(files: DataFrame, chars: int | None = NATIVE_CHARS) -> DataFrame:
    """Game files by where they lie: items, recipes, else mechanics; each text is cut at ``chars``, whole where that is None."""
    low = F.lower("path")
    where = F.when(low.contains("item"), "items").when(low.contains("recipe") | low.contains("craft"), "recipes").otherwise("mechanics")
    return texts(files).select("path", where.alias("collection"), (F.col("text") if chars is None else F.left("text", F.lit(chars))).alias("text"))


def scripts_first(files: DataFrame, skip: list[str] = SKIPPED_EXTENSIONS) -> DataFrame:
    """Files without skipped extensions, scripts before configs."""
    ext = extension(F.col("path"))
    return files.filter(~ext.isin(*skip)).withColumn("phase", F.when(ext == "lua", 1).otherwise(2)).orderBy("phase", "path")


def check_manifests(files: DataFrame) -> DataFrame:
    """Static checks of each package: an error per missing manifest or field, a warning per missing folder."""
    mine = files.withColumn("package", folder_id(F.col("path"))).filter(F.col("package").isNotNull())
    info = texts(mine.filter(F.lower("path").endswith("/mod.info"))).select("package", "text")
    have = mine.groupBy("package").agg(*[F.max(F.col("path").contains(f"/{d}/")).alias(f"__f{i}") for i, d in enumerate(EXPECTED_FOLDERS)])
    out = have.join(info, "package", "left")
    errors = [F.when(F.col("text").isNull(), F.struct(F.lit("error").alias("level"), F.lit("mod.info is missing").alias("message")))]
    errors += [F.when(F.col("text").isNotNull() & ~F.col("text").rlike(rf"(?m)^\s*{f}\s*="), F.struct(F.lit("error").alias("level"), F.lit(f"{f} is missing").alias("message"))) for f in REQUIRED_FIELDS]
    warnings = [F.when(~F.col(f"__f{i}"), F.struct(F.lit("warning").alias("level"), F.lit(f"{d} is missing").alias("message"))) for i, d in enumerate(EXPECTED_FOLDERS)]
    return out.select("package", F.inline(F.filter(F.array(*errors, *warnings), lambda x: x.isNotNull())))


def log_alerts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines that tell of errors, with the first pattern that fits."""
    kind = None
    for name, pattern in LOG_ERRORS.items():
        kind = F.when(F.col(column).rlike(pattern), name) if kind is None else kind.when(F.col(column).rlike(pattern), name)
    return lines.withColumn("alert", kind).filter(F.col("alert").isNotNull())


def commits(log: DataFrame, column: str = "value") -> DataFrame:
    """Commit subjects by conventional prefix; release commits are left out."""
    kind = F.regexp_extract(column, r"^(\w+)(?:\([^)]*\))?!?:", 1)
    rows = log.filter(~F.col(column).rlike(r"(?i)^(release|chore\(release\))")).withColumn("kind", F.when(kind == "", "other").otherwise(F.lower(kind)))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(column)).alias("subjects"))


def page_chunks(rows: DataFrame, limit: int = 512) -> DataFrame:
    """Texts with ``--- Page`` marks: pages, then sentences packed up to the limit."""
    pages = rows.select("source", F.posexplode(chunking.pages(F.col("text"))).alias("page", "part"))
    return pages.select("source", "page", F.posexplode(chunking.pack(chunking.sentences(F.col("part")), limit, " ")).alias("idx", "text"))

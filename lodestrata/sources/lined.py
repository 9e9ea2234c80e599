"""Records of files that are read by line: Markdown, Lua documentation and CSV. A file may be of any size; its lines are spread over
as many tasks as it has parts, and no task holds a file, a section or a record whose quote is never closed.

Lines that aren't UTF-8 are decoded by the cascade one by one. Blank files give no record.
"""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import stored
from .files import decoded, literal_paths
from .lines import HEADING, csv_records, headed, lines, plain_path

#: Characters of a section, or of a record of a CSV file, beyond which it goes on in a further record.
RECORD_CHARS = 1 << 20
#: Most bytes of headers that are broadcast.
HEADER_BYTES = 16 << 20
DOCUMENTED = r"^##\s+(.*?)\s*#*$"
PARAMETER = r"(?mU)^###\s+(\w+)\s*:\s*([\w.<>\[\]]+)(?:\s*(?:—|-)\s*(.*))?$"
#: A line that makes a file Lua documentation.
TYPED = r"(?U)^###\s+\w+\s*:\s*[\w.<>\[\]]+(?:\s*(?:—|-)\s.*)?$"
EXTENSIONS = {".md": "markdown", ".csv": "csv"}
PATTERN = r"(?i)\.(md|csv)$"


def kind_of(path: str) -> str | None:
    """The kind of a file that is read by line, or None."""
    return next((kind for end, kind in EXTENSIONS.items() if path.lower().endswith(end)), None)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = lines(spark, literal_paths(paths))
    text = F.replace(decoded(F.col("line").cast("binary")), F.lit("\u0000"), F.lit(""))
    return found.withColumn("path", plain_path(F.col("path"))).withColumn("line", F.when(F.col("part") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text))


@F.pandas_udf(StringType())
def merged(objects: pd.Series) -> pd.Series:
    """JSON objects as one, later keys win; null where one isn't an object."""

    def one(texts: list[str] | None) -> str | None:
        out: dict = {}
        try:
            for t in [] if texts is None else texts:
                out.update(json.loads(t))
        except (TypeError, ValueError):
            return None
        return json.dumps({k: v for k, v in out.items() if v not in (None, "", [], {})}, ensure_ascii=False, sort_keys=True)

    return objects.map(one)


def _sections(found: DataFrame, heading: str) -> DataFrame:
    """path, section, piece, name and body. A section's text beyond ``RECORD_CHARS`` goes on in further pieces."""
    rows = headed(found, heading)
    below = F.when((F.col("section") == 0) | (F.col("place") > 0), F.struct("n", "line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(below)), lambda x: x["line"]), "\n")
    return rows.groupBy("path", "section", F.floor(F.col("offset") / RECORD_CHARS).alias("piece"), F.col("heading").alias("name")).agg(stripped(body).alias("body"))


def _index(place: Column, piece: Column) -> Column:
    return place.cast("long") + piece.cast("long") * (1 << 32)


def markdown(found: DataFrame) -> DataFrame:
    """A record for each section; ``<!-- meta: {json} -->`` comments give its metadata, other comments go."""
    cut = _sections(found, HEADING).filter((F.col("name") != "") | (F.col("body") != ""))
    metas = F.regexp_extract_all("body", F.lit(r"(?s)<!--\s*meta:\s*(\{.*?\})\s*-->"), 1)
    told = cut.withColumn("metadata", F.when(F.size(metas) == 0, "{}").otherwise(merged(metas)))
    text = stripped(F.concat("name", F.lit("\n"), F.regexp_replace("body", r"(?s)<!--.*?-->", "")))
    error = F.when(F.col("metadata").isNull(), F.lit("ValueError: metadata isn't a JSON object"))
    return told.select("path", F.lit("markdown").alias("kind"), _index(F.col("section"), F.col("piece")).alias("record_index"), "name", text.alias("text"), "metadata", error.alias("error"))


def lua_doc(found: DataFrame) -> DataFrame:
    """Documented functions: ``## name`` sections whose ``### parameter : type — text`` lines are the parameters."""
    cut = _sections(found, DOCUMENTED).filter((F.col("section") > 0) & (F.col("name") != ""))
    groups = [F.regexp_extract_all("body", F.lit(PARAMETER), i) for i in (1, 2, 3)]
    parameters = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("name", "type", "text"), strict=True)])
    metadata = F.when(F.size(groups[0]) == 0, "{}").otherwise(F.to_json(F.struct(parameters.alias("parameters"))))
    text = stripped(F.concat("name", F.lit("\n"), F.regexp_replace("body", r"(?m)^###.*$", "")))
    return cut.select("path", F.lit("markdown").alias("kind"), _index(F.col("section"), F.col("piece")).alias("record_index"), "name", text.alias("text"), metadata.alias("metadata"), F.lit(None).cast("string").alias("error"))


def csv(found: DataFrame) -> DataFrame:
    """A record for each row under the header's names; a row of another width is kept raw."""
    rows = stored(csv_records(found, RECORD_CHARS))
    heads = rows.filter("record = 0 AND piece = 0").select(F.col("path").alias("__path"), F.col("fields").alias("head"))
    size = heads.agg(F.sum(F.length(F.array_join("head", ",")) + F.length("__path"))).first()[0] or 0
    joined = rows.filter("record > 0").join(F.broadcast(heads) if size <= HEADER_BYTES else heads, F.col("path") == F.col("__path"), "left")
    fits = (F.col("piece") == 0) & (F.size("fields") == F.size("head"))
    named = F.when(fits, F.map_from_arrays(F.transform("head", stripped), F.transform("fields", stripped))).otherwise(F.create_map(F.lit("raw"), F.array_join("fields", ",")))
    told = joined.withColumn("row", named)
    text = F.array_join(F.transform(F.map_entries("row"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    name = F.coalesce(F.try_element_at("row", F.lit("name")), F.try_element_at("row", F.lit("id")), (F.col("record") - 1).cast("string"))
    metadata = F.to_json(F.map_filter("row", lambda k, v: v != ""))
    return told.select("path", F.lit("csv").alias("kind"), _index(F.col("record") - 1, F.col("piece")).alias("record_index"), name.alias("name"), stripped(text).alias("text"), metadata.alias("metadata"), F.lit(None).cast("string").alias("error"))


def records(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """path, kind, record_index, name, text, metadata and error of those files of a block that are read by line."""
    marked = [p for p in paths if kind_of(p) == "markdown"]
    # paths of the block, which is bounded
    docs = {r.path for r in _lines(spark, marked).filter(F.col("line").rlike(TYPED)).select("path").distinct().collect()} if marked else set()
    lua, other = [p for p in marked if p in docs], [p for p in marked if p not in docs]
    rows = [p for p in paths if kind_of(p) == "csv"]
    parts = [read(_lines(spark, some)) for some, read in ((other, markdown), (lua, lua_doc), (rows, csv)) if some]
    return functools.reduce(DataFrame.unionByName, parts) if parts else None

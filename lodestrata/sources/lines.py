"""Text files as rows of lines, in their order, and what lies between certain lines (sections below headings, records of a CSV file)
as islands of a running sum.

A file is read in as many parts as Spark cuts it into, however large it is; no task holds a file or a section. Lines are dealt by
their part, once, and counted there. What a part adds is told by one row, and sums over these rows give each part what stands
before it in its file. Whether a part begins within a fence or a quoted field is known only then, so parts are told in both readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADING = r"^#{1,6}\s+(.*?)\s*#*$"


def plain_path(path: Column) -> Column:
    """A file's path as listings give it: readers of lines encode it as a URL."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def lines(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """path, part, at and line of the text files at a path; ``at`` orders the lines of a part. Lines end at line feeds. ``at`` may
    differ from one reading to the next, the order within a part doesn't, so nothing is stored; files must stay as they are."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    read = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("line"))
    # by bytes, as they needn't be UTF-8
    bare = F.substr(F.col("line").cast("binary"), F.lit(1), F.octet_length("line") - 1).cast("string")
    return read.withColumn("at", F.monotonically_increasing_id()).select("path", "part", "at", F.when(F.endswith("line", F.lit("\r")), bare).otherwise(F.col("line")).alias("line"))


def islands(found: DataFrame, opens: Column, title: Column, toggles: Column) -> DataFrame:
    """path, n (the line's number in its file, from 1), line, island (how many lines up to this one have opened an island), inside
    (an odd number of ``toggles`` come before the line), chars (characters of the file up to the end of the line, line ends
    included) and head (n, chars and title of the line that opened its island, or null). A line opens one if ``opens`` holds and it
    isn't inside."""
    part = Window.partitionBy("path", "part").orderBy("at")
    up_to = part.rowsBetween(Window.unboundedPreceding, 0)

    def counted(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("__t", toggles.cast("long")).withColumn("__o", F.coalesce(opens, F.lit(False))).withColumn("__title", F.when(F.col("__o"), title)).withColumn("__len", F.length("line").cast("long") + 1)
        summed = marked.withColumn("__n", F.row_number().over(part).cast("long")).withColumn("__chars", F.sum("__len").over(up_to)).withColumn("__ts", F.sum("__t").over(up_to))
        return summed.withColumn("__odd", (F.col("__ts") - F.col("__t")) % 2)

    def head(n: Column, chars: Column) -> Column:
        return F.struct((n + F.col("__n")).alias("n"), (chars + F.col("__chars")).alias("chars"), F.col("__title").alias("title"))

    reading = lambda k: F.col("__o") & (F.col("__odd") == k)
    sums = [x for k in (0, 1) for x in (F.count_if(reading(k)).alias(f"o{k}"), F.max(F.when(reading(k), head(F.lit(0), F.lit(0)))).alias(f"h{k}"))]
    parts = counted(found).groupBy("path", "part").agg(F.max("__n").alias("n"), F.max("__chars").alias("chars"), F.sum("__t").alias("t"), *sums)
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    told = parts.select("*", total("n").alias("n0"), total("chars").alias("chars0"), (total("t") % 2).alias("odd0"))
    even = F.col("odd0") == 0
    last = F.when(even, F.col("h0")).otherwise(F.col("h1"))
    last = F.when(last.isNotNull(), F.struct((F.col("n0") + last["n"]).alias("n"), (F.col("chars0") + last["chars"]).alias("chars"), last["title"].alias("title")))
    told = told.withColumn("mine", F.when(even, F.col("o0")).otherwise(F.col("o1"))).withColumn("last", last)
    starts = told.select(F.col("path").alias("__path"), F.col("part").alias("__part"), "n0", "chars0", "odd0", total("mine").alias("island0"), F.last("last", True).over(before).alias("head0"))
    out = counted(found.join(starts, (F.col("path") == F.col("__path")) & (F.col("part") == F.col("__part"))))
    out = out.withColumn("inside", (F.col("__odd") + F.col("odd0")) % 2 == 1).withColumn("__o", F.col("__o") & ~F.col("inside"))
    out = out.withColumn("island", F.col("island0") + F.sum(F.col("__o").cast("long")).over(up_to))
    out = out.withColumn("head", F.coalesce(F.last(F.when(F.col("__o"), head(F.col("n0"), F.col("chars0"))), True).over(up_to), F.col("head0")))
    return out.select("path", (F.col("n0") + F.col("__n")).alias("n"), "line", "island", "inside", (F.col("chars0") + F.col("__chars")).alias("chars"), "head")


def headed(found: DataFrame, heading: str = HEADING, fence: str | None = r"^\s*```") -> DataFrame:
    """path, n, line, section (0 before the first heading), heading, place (the line's number below its heading; 0 is the heading
    itself) and offset (characters between the heading and the line). ``heading`` is a pattern whose first group is the title;
    between lines that meet ``fence`` nothing is a heading."""
    fenced = F.coalesce(F.col("line").rlike(fence), F.lit(False)) if fence else F.lit(False)
    out = islands(found, F.col("line").rlike(heading) & ~fenced, F.regexp_extract("line", heading, 1), fenced.cast("int"))
    start = F.coalesce(F.col("head.chars"), F.lit(0))
    below = F.col("chars") - F.length("line") - 1 - start
    return out.select("path", "n", "line", F.col("island").alias("section"), F.coalesce("head.title", F.lit("")).alias("heading"), (F.col("n") - F.coalesce("head.n", F.lit(0))).alias("place"), F.greatest(below, F.lit(0)).alias("offset"))


def _joined(n: str = "n", line: str = "line") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, line))), lambda x: x[line]), "\n")


def section_pieces(rows: DataFrame, limit: int = 4096) -> DataFrame:
    """path, section, heading, piece and text: a section's lines below its heading in pieces that begin about every ``limit``
    characters, so that none grows with the section; a line is never cut. Pieces that are blank go."""
    below = rows.filter((F.col("section") == 0) | (F.col("place") > 0)).withColumn("piece", F.floor(F.col("offset") / limit))
    return below.groupBy("path", "section", "heading", "piece").agg(_joined().alias("text")).filter(F.trim("text") != "")


def csv_records(found: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """path, record (from 0; the first is the header), piece and fields: the records of CSV files. A quoted field may hold commas, line
    ends and doubled quotes; blank lines between records go. What follows on a record for over ``limit`` characters, as after
    a quote that is never closed, comes in raw pieces of that size with one field each, so that none grows with the file."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    blank = F.regexp_replace("line", r'[\s,"]', "") == ""
    out = islands(found, ~blank, F.lit(None).cast("string"), quotes).filter(F.col("inside") | ~blank)
    piece = F.floor((F.col("chars") - F.coalesce("head.chars", F.lit(0))) / limit)
    made = out.groupBy("path", (F.col("island") - 1).alias("record"), piece.alias("piece")).agg(_joined().alias("text"))
    return made.select("path", "record", "piece", F.when((F.col("piece") > 0) | ((F.length("text") - F.length(F.replace("text", F.lit('"')))) % 2 == 1), F.array("text")).otherwise(csv_fields(F.col("text"))).alias("fields"))


def csv_fields(text: Column) -> Column:
    """The fields of a record. Of what quotes cut a record into, each second piece was quoted; an empty one that was not,
    between two that were, stands for a quote."""
    cut = F.split(text, '"', -1)

    def bit(s: Column, i: Column) -> Column:
        doubled = (s == "") & (i > 0) & (i < F.size(cut) - 1)
        return F.when(i % 2 == 1, s).when(doubled, F.lit('"')).otherwise(F.replace(s, F.lit(","), F.lit("\u0000")))

    return F.split(F.array_join(F.transform(cut, bit), ""), "\u0000", -1)

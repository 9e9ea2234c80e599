"""Session settings that the engine expects: UTC, adaptive execution, later keys win when maps are merged."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(app: str = "lodestrata", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str = "lodestrata") -> str:
    """A new folder below ``spark.checkpoint.dir``; it goes when the JVM ends. Where that is unset, a temporary folder
    serves local masters; a cluster's executors don't share one, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/lodestrata"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write rows as Parquet to a shared folder and read them back: computed once, and proof against lost executors."""
    path = path or f"{shared_dir(df.sparkSession)}/t"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of constants as a plan of literals, without Python at run time. ``schema`` is "name type, ..."."""
    fields = [f.split() for f in schema.split(",")]
    made = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))

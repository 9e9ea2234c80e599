"""A pipeline over ``documents``: language, near-duplicates, personal data, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of ``documents`` and pass extra ones through. ``run`` writes each stage's rows to the shared folder and reads them back, so
a lost executor never costs more than a stage.

Null and empty texts have no language and go in the first stage, as do texts without letters. Of rows that share an id
one stays, rows with a null id all stay. Ties and repeated rows are settled by hashes, so reruns agree. Very long texts are
handled whole by all stages. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import langid, mixing, neardup, packing, pii
from lodestrata.llm.common import shared_dir, stored

#: Below this score, or without letters, a document's language counts as unknown and the document goes.
LEAST_SCORE = 0.2
#: Percent of common five-word shingles from which documents are near-duplicates.
SIMILAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs, least=LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, SIMILAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packed", packed),
]

#: SQL can't train the models of two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

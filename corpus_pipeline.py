"""From raw documents to packed token windows, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; a run writes each stage's rows as Parquet in the
shared folder and reads them again as the next one's ``docs``. All stages but the last keep the columns of ``documents``, and
extra ones of any name, as they are. NULL texts have no language and go in the first stage; empty tables stay empty; rows alike
in id and text are one document, of which the near-duplicate stage keeps one row; rows without an id are kept by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import decontamination, language_id, packing, secrets, simhash_dedup
from fieldtally.llm.common import free_name, quoted, table
from fieldtally.llm.queries import language_model, tokenizer_files
from fieldtally.lineage import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: NULL texts and texts without a letter."""
    names = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = language_id.identified(docs, language_model(docs), names=names)
    return found.where(F.col(names[0]) != language_id.UNKNOWN).select(*quoted(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return simhash_dedup.first_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces found secrets by a mark."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 1024."""
    return packing.pack(docs, *tokenizer_files())


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_secrets", without_secrets),
    ("packed", packed),
]

ORACLE_SQL = None  # fingerprints, mixtures and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's rows are removed once the next one's are written; the last one's stay."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

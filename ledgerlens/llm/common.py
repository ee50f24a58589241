"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROWS_PER_BATCH = 256
# Words end at ASCII white space only.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Only A-Z is lower-cased."""
    return F.translate(text, UPPER, UPPER.lower())


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Rows hold whole documents, so a Python task gets few of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def keep_rows(docs: DataFrame, kept: DataFrame, digest: Column, name: str) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, digest) is in ``kept`` (doc_id, name), each such pair once."""
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    wanted = kept.select(text_id.alias("_id"), F.col(name).alias("_digest"))
    rows = docs.select(text_id.alias("_id"), digest.alias("_digest"), F.struct("*").alias("row"))
    rows = rows.join(wanted, ["_id", "_digest"], "left_semi")
    return rows.dropDuplicates(["_id", "_digest"]).select("row.*")

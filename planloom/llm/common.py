"""Small helpers the corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.session import discard, scratch, stored  # noqa: F401  re-exported for the operators

#: A word: the longest run of bytes that are neither a space nor one of 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, whatever folder they were
    started in. Where executors cannot see that folder, ship the package with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. In pure ASCII text, whose bytes and characters are as many, plain
    lower() does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def text_of(name: str) -> Column:
    """A text column as it counts: null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_batches(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state per task: build() makes the function that takes one batch."""

    def run(batches):
        step = build()
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)

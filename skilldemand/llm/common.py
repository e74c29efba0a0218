"""What the operators share: reading, staging, folds and normalisation of rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` of the session; where that is unset, as in tests, a folder
    in the warehouse, which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in the jobs that run inside the block.

    Texts may be long, and a batch is held by the executor, by its Python worker and, while
    the next one is read, twice. The session's own setting comes back afterwards.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    least = min(rows, int(before)) if int(before) > 0 else rows
    spark.conf.set(name, str(least))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text modulo ``folds``; a null key is in the fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, in any locale."""
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, so that extra columns never clash."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted

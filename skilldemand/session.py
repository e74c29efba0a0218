"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skilldemand", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs expect; cluster settings win where given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, the folder all executors share.

    Where that is unset, as in tests, a folder in the warehouse, which is shared too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "scratch")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back, which cuts their lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries in the block go when each ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that this job has staged, in whatever store it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

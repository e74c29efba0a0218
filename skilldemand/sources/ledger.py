"""Weekly tables that change by whole runs, and runs that may be repeated.

The rows of a week lie in ``week_start=W/run=R``, written by run R. The ledger has one entry
for each finished run with its weeks; the newest entry that names a week tells which run's
folder holds it. A run writes its folders beside the old ones and only then its entry, so
readers see all of a run or nothing of it. A run that is repeated after its entry is done
already; one that was lost before it overwrites its own folders. Runs of a table go one
after the other.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_WEEKS = 5_000  # of a table: nearly a century

ENTRY = "seq long, run string, weeks array<struct<week_start: date, filled: boolean>>"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class WeeklyTable:
    """A table of a schema with ``week_start``, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def entries(self) -> DataFrame:
        if not _exists(self.spark, f"{self.path}/ledger"):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/ledger/run=*")

    def committed(self, run: str) -> bool:
        return _exists(self.spark, f"{self.path}/ledger/run={run}/_SUCCESS")

    def current(self) -> dict[dt.date, str | None]:
        """The run that holds each week; None for a week that its run left empty."""
        named = self.entries().select("seq", "run", F.explode("weeks").alias("w"))
        newest = named.groupBy("w.week_start").agg(F.max_by(F.struct("run", "w.filled"), "seq").alias("at"))
        rows = newest.limit(MAX_WEEKS + 1).collect()
        if len(rows) > MAX_WEEKS:
            raise ValueError(f"more than {MAX_WEEKS} weeks")
        return {r["week_start"]: r["at"]["run"] if r["at"]["filled"] else None for r in rows}

    def read(self, weeks: list[dt.date] | None = None) -> DataFrame:
        """The current rows, or those of some weeks; no other folder is listed or read."""
        held = self.current()
        wanted = sorted(held) if weeks is None else sorted(set(weeks) & set(held))
        paths = [f"{self.path}/rows/week_start={w}/run={held[w]}" for w in wanted if held[w]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        named = T.StructType([*self.schema.fields, T.StructField("run", T.StringType())])
        rows = self.spark.read.schema(named).option("basePath", f"{self.path}/rows").parquet(*paths)
        return rows.select(self.schema.names)

    def replace(self, rows: DataFrame, weeks: list[dt.date], run: str) -> None:
        """Make ``rows`` all that the weeks hold, as a run."""
        if self.committed(run):
            return
        named = rows.select(*self.schema.names, F.lit(run).alias("run"))
        # one file per week where possible; a very large week is still split over tasks
        writer = named.hint("rebalance", "week_start").write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("week_start", "run").parquet(f"{self.path}/rows")
        filled = [w for w in weeks if _exists(self.spark, f"{self.path}/rows/week_start={w}/run={run}")]
        seq = self.entries().agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).first()[0]
        entry = [(seq, [(w, w in filled) for w in weeks])]
        kinds = "seq long, weeks array<struct<week_start: date, filled: boolean>>"
        rows = self.spark.createDataFrame(entry, kinds).withColumn("run", F.lit(run)).select("seq", "run", "weeks")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/run={run}")

    def compact(self) -> int:
        """Delete the folders of weeks that newer runs hold; the number of them."""
        held, gone = self.current(), 0
        named = self.entries().select("run", F.explode("weeks").alias("w")).where("w.filled")
        for r in named.select("run", "w.week_start").distinct().toLocalIterator():
            folder = f"{self.path}/rows/week_start={r['week_start']}/run={r['run']}"
            if held.get(r["week_start"]) != r["run"] and _exists(self.spark, folder):
                _delete(self.spark, folder)
                gone += 1
        return gone


def weeks_of(*tables: DataFrame) -> list[dt.date]:
    """The distinct weeks of some tables, which are few whatever their rows."""
    each = [t.select("week_start") for t in tables]
    both = each[0]
    for t in each[1:]:
        both = both.union(t)
    rows = both.where("week_start is not null").distinct().limit(MAX_WEEKS + 1).collect()
    if len(rows) > MAX_WEEKS:
        raise ValueError(f"more than {MAX_WEEKS} weeks")
    return sorted(r["week_start"] for r in rows)

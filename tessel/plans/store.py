"""Tables in the folder that the whole cluster shares: steps written once, and results kept by key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset on a single machine (tests), a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet, a folder for each value of ``by`` if given, and read again: cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


class Results:
    """Rows kept by key in a folder of Parquet batches; of a key's rows the one of the latest version counts.

    ``put`` writes a batch folder named by the caller, in overwrite mode: a job that is run again, or twice at the same
    time, replaces its own batch by the same rows and no key doubles.  ``compact`` writes what ``latest`` returns as a
    batch of its own and removes nothing: the batches that it covers are listed in its name's file, and readers skip them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, version: str):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version

    def put(self, rows: DataFrame, batch: str) -> None:
        """Keeps ``rows`` under a batch id (letters, digits, ``-``) that is the same when the job is run again."""
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")

    def _batches(self) -> DataFrame | None:
        """All batches with the column ``batch``, without those that a compaction covers."""
        try:
            rows = self.spark.read.option("basePath", f"{self.path}/rows").option("mergeSchema", "true").parquet(f"{self.path}/rows/batch=*")
        except AnalysisException:  # nothing kept yet
            return None
        rows = rows.withColumn("batch", F.col("batch").cast("string"))
        try:
            covered = self.spark.read.schema("batch string, into string").parquet(f"{self.path}/covered/*")
        except AnalysisException:
            return rows
        return rows.join(covered.select("batch").distinct(), "batch", "left_anti")

    def latest(self) -> DataFrame | None:
        """One row for each key: that of the largest version (ties: the last batch by name, then the largest row); None if nothing is kept."""
        rows = self._batches()
        if rows is None:
            return None
        kept = [c for c in rows.columns if c != "batch"]
        order = Window.partitionBy(self.key).orderBy(F.desc(self.version), F.desc("batch"), F.desc(F.xxhash64(*kept)))
        return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").select(*kept)

    def missing(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key has no result yet."""
        found = self.latest()
        return keys if found is None else keys.join(found.select(self.key), self.key, "left_anti")

    def compact(self, batch: str) -> None:
        """Merges all present batches into one named ``batch``; may be run again after a failure at any point."""
        rows = self._batches()
        if rows is None:
            return
        covered = written(rows.select("batch").distinct().where(F.col("batch") != batch), "covered")
        self.put(self.latest(), batch)
        covered.select("batch", F.lit(batch).alias("into")).write.mode("overwrite").parquet(f"{self.path}/covered/{batch}")

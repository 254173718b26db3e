"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage here: each step's small result is written as Parquet below
``spark.checkpoint.dir`` and read again, so that a lost executor costs one read and not a replay.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[str, Scratch] = {}
#: While a table is written, Spark deletes the query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Row groups of tables whose rows hold packed arrays. Parquet would look at their size after 100 rows only, and a
#: reader takes up to 4,096 rows of a row group at once, so writers and readers would hold all that a task has.
_LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}


class Scratch:
    """Writes and drops tables of one application below the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="recallspark-")
        self.root = f"{base.rstrip('/')}/recallspark-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        self._paths: dict[int, str] = {}
        atexit.register(self.clear)

    @classmethod
    def of(cls, spark: SparkSession) -> Scratch:
        app = spark.sparkContext.applicationId
        if app not in _OPEN:
            _OPEN[app] = cls(spark)
        return _OPEN[app]

    def save(self, df: DataFrame, partition_by: str | None = None, large_rows: bool = False) -> DataFrame:
        """Writes df and returns it as a scan of what was written; ``large_rows`` (some kilobytes to megabytes) in small row groups."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        writer = df.write.options(**_LARGE_ROWS) if large_rows else df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Deletes tables that no later plan reads."""
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                self._delete(path)

    def release_shuffles(self) -> None:
        """Lets Spark delete shuffle files of finished queries before the next large stage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; its folder goes with it
            pass

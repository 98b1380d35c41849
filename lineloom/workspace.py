"""Shared intermediate tables.

Iterative operators cut their lineage by writing a Parquet table into the folder every executor can reach
(``spark.checkpoint.dir``).  Reading a written table back has two benefits over an RDD checkpoint: a lost executor
costs a re-read and nothing more, and Spark knows the byte size, so its own ``autoBroadcastJoinThreshold`` check
decides between a broadcast and a shuffle join.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only on a local master where none is named."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lineloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Workspace:
    """Hands out fresh table paths below one folder of the shared directory."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/lineloom-{uuid.uuid4().hex}"
        self._serial = 0

    def path(self, name: str) -> str:
        self._serial += 1
        return f"{self.root}/{self._serial:04d}-{name}"

    def table(self, df: DataFrame, name: str, spread: str | None = None, codec: str | None = None) -> DataFrame:
        """Write ``df`` once and return the written table; ``codec`` is for one that stays long, where the session's packs less.

        ``spread`` names a key to deal the rows by.  It is for tables that feed comparisons: their work grows with
        the compared rows and not with their bytes, so files merged up to a common size would make long tasks.
        """
        if spread is not None:
            df = df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), spread)
        path = self.path(name)
        df.write.parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: DataFrame) -> None:
        """Delete the files of a table of this workspace that nothing will read any more."""
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/lineloom-" in file:
                self._delete(file)

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of jobs that are over: its cleaner follows the driver's garbage collections."""
        gc.collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        """Delete everything below this workspace."""
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

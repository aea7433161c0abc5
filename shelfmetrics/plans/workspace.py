"""Written intermediate tables in the folder the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, scratch: str | None = None) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the session names none, a local one may use ``scratch``, a folder of this machine:
    its executors are this very process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if scratch and spark.sparkContext.master.startswith("local"):
        return scratch
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def sized_by(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` gathered by what their folder will be, in parts of the advisory size.

    Adaptive execution merges small parts and splits large ones, so the files of a folder
    follow its bytes and not the number of tasks; a value that nearly all rows have is split.
    """
    return rows.hint("rebalance", F.col(folder))


@contextmanager
def open_folders(spark: SparkSession, most: int = 16) -> Iterator[None]:
    """A task that writes by folder keeps up to ``most`` files open instead of sorting its rows first.

    The rows then neither move nor wait in memory for the sort; there are no more files per folder
    than tasks, and the tasks follow the bytes that are read or shuffled.
    """
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


class Workspace:
    """Writes a DataFrame once and hands back a scan of what was written.

    This cuts the lineage in a way that survives the loss of executors, and the
    scan comes with the true size of the data, from which Spark picks its joins.
    """

    def __init__(self, spark: SparkSession, scratch: str | None = None):
        self.spark = spark
        app = spark.sparkContext.applicationId
        self.folder = f"{shared_folder(spark, scratch).rstrip('/')}/shelfmetrics/{app}/{uuid4().hex}"

    def save(self, rows: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid4().hex}"
        writer = rows.write.mode("errorifexists")
        if partition_by:
            with open_folders(self.spark):
                writer.partitionBy(partition_by).parquet(path)
        else:
            writer.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).select(*rows.columns)

    def close(self) -> None:
        """Remove everything that was saved."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

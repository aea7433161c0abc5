"""Written intermediate tables in the shared folder, and numbering without a single task."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}
_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in these low bits


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local session without one gets its own folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN_FOLDERS:
        _OWN_FOLDERS[application] = "file://" + tempfile.mkdtemp(prefix="shelfmetrics-llm-")
    return _OWN_FOLDERS[application]


def new_path(spark: SparkSession, label: str) -> str:
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/shelfmetrics-llm/{application}/{label}-{uuid.uuid4().hex}"


class Stages:
    """The tables one operator call has written; ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}

    def write(self, rows: DataFrame, label: str, folders: list[str] | None = None) -> DataFrame:
        """Cut the lineage: write as Parquet, in a folder per value of ``folders``, read back."""
        return self.write_to(rows, self.folder(label), folders)

    def folder(self, label: str) -> str:
        return new_path(self.spark, label)

    def write_to(self, rows: DataFrame, path: str, folders: list[str] | None = None) -> DataFrame:
        rows.write.parquet(path, partitionBy=folders)
        read = self.spark.read.schema(rows.schema).parquet(path)
        self._paths[id(read)] = path
        return read

    def free_shuffles(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more.

        Its cleaner acts when the driver collects garbage, which a large heap seldom does.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, rows: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(rows)))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(path, True)


def numbered(stages: Stages, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 0) in the given total order.

    Range partitions are sorted and counted on their own; only one count per partition meets
    in a window.
    """
    place = F.monotonically_increasing_id()
    spread = stages.write(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place),
        "numbered",
    )
    part = F.shiftright("__place", _ROW_BITS)
    counts = spread.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = F.expr(
        "coalesce(sum(__rows) over (order by __part"
        " rows between unbounded preceding and 1 preceding), 0)"
    )
    starts = counts.select("__part", before.alias("__start"))
    within = F.col("__place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        spread.join(starts, part == F.col("__part"))
        .withColumn(name, F.col("__start") + within)
        .drop("__place", "__part", "__start")
    )

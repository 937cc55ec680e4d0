"""What every operator needs of the session: the shared folder, cut lineages, unions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only on a local master where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ringweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Folders that this process's operators wrote to.
_BASES: set[str] = set()


def remove_scratch(spark: SparkSession) -> None:
    """Removes all intermediate tables of this process; results that were not stored before can no longer be read."""
    while _BASES:
        _remove(spark, _BASES.pop())


class Scratch:
    """Tables an iterative operator writes to the shared folder, so that lost executors cost no recomputation.

    A table whose data are no longer needed can be dropped before the operator ends; the rest stays as long as the
    lazily evaluated result may need it, until ``remove_scratch`` is called.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/ringweave-{what}-{uuid.uuid4().hex}"
        _BASES.add(self.base)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Evaluates df, and returns the written table."""
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.base}/{name}")


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for df in rest:
        first = first.unionByName(df)
    return first

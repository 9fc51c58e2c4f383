"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one where none is set and one machine does all (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="deltaloom-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """SQL settings that hold for the statements inside; dots are written as double underscores."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files of a statement go when it ends, not when the driver collects garbage.
FREE_SHUFFLE = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


class Scratch:
    """Named Parquet tables of one operator run.

    A written table cuts the lineage: a lost executor costs a re-read, not a
    recomputation, and what was written once is never dealt out differently
    by a retry.  ``drop`` removes a table as soon as no later step reads it;
    the rest goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        root = self._path(self.root)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)
        self._fs.deleteOnExit(root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def narrow(self, df: DataFrame, name: str) -> DataFrame:
        """As :meth:`write`, for rows of a few numbers: two tasks a core write them, or one for eight shuffle partitions.

        A task reads its shuffle partitions one after the other, so it holds no
        more than before.  Hadoop's local file system starts a process for every
        file that it makes, which costs more than such a file's rows.
        """
        tasks = max(2 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        return self.write(df.coalesce(tasks), name)

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """As :meth:`write`, dealt by ``key`` in one exchange; joins on it leave these rows where they are.

        The catalog holds the table only until it is resolved here.
        """
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        table = f"deltaloom_{name}_{uuid.uuid4().hex}"
        try:
            df.repartition(n, key).write.bucketBy(n, key).option("path", f"{self.root}/{name}").option("compression", "zstd").saveAsTable(table)
            return self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

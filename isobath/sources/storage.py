"""Where tables go that a job writes on its way: a folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; only a local session gets a temporary folder of its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            found = given.get()
        elif re.match(r"local(\[|$)", context.master):
            if context.applicationId not in _own:
                folder = tempfile.mkdtemp(prefix="isobath-")
                atexit.register(shutil.rmtree, folder, ignore_errors=True)
                _own[context.applicationId] = "file://" + folder
            found = _own[context.applicationId]
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return found.rstrip("/")


class Store:
    """Tables written into one folder and read again, which cuts their lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.names: list[str] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that are no longer read."""
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            self._delete(path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """The table dealt once to buckets of a column: joins on it do not move it again."""
        self.n += 1
        name = f"t{uuid.uuid4().hex}"
        df.repartition(buckets, column).write.option("path", f"{self.folder}/{self.n}").bucketBy(buckets, column).sortBy(column).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Delete the folder; tables that are still to be read must not be in it."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._delete(self.folder)

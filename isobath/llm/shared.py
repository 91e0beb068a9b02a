"""What the operators of this subpackage have in common."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder of its own, which goes with the process; a
    cluster gets an error, as its machines would not see each other's local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        set_ = context._jsc.sc().getCheckpointDir()
        if set_.isDefined():
            found = set_.get()
        elif re.match(r"local(\[|$)", context.master):
            if context.applicationId not in _own:
                folder = tempfile.mkdtemp(prefix="isobath-")
                atexit.register(shutil.rmtree, folder, ignore_errors=True)
                _own[context.applicationId] = "file://" + folder
            found = _own[context.applicationId]
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return found.rstrip("/")


def shielded(docs: DataFrame) -> tuple[list[str], list[Column]]:
    """Names by place for docs.toDF(..), which no internal column can clash with, and the columns under their own names again."""
    hidden = [f"given_{i}" for i in range(len(docs.columns))]
    return hidden, [F.col(h).alias(c) for h, c in zip(hidden, docs.columns, strict=True)]


_folder: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables materialised inside go to a folder of their own, which is deleted at the end."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(token)
        _delete(spark, folder)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again.

    It cuts the lineage, survives lost executors, and tells the planner the table's real size, so
    that a join broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = f"{_folder.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that is no longer needed."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def n_words(text: Column) -> Column:
    """Number of words as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]

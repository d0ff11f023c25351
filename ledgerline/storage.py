"""Tables between jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PREFIX = "ledgerline-"


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that all executors share (spark.checkpoint.dir).

    Where the setting is absent a local session makes a temporary folder and sets it once; a session on a
    cluster raises an error, since its executors could not read a local folder.
    """
    return f"{_root(spark)}/{_PREFIX}{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


#: What is staged inside each ``scratch`` that is open.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end, unless it is to stay."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, _SCRATCH.pop()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a narrow table that are sent to all executors, some 100 MB at most.
_FEW = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """A narrow table for a join: broadcast if it has few rows, which are counted; else shuffled with the other side, as ever."""
    return F.broadcast(df) if df.limit(_FEW + 1).count() <= _FEW else df


def stage(df: DataFrame, by: str | None = None, stays: bool = False) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage and survives lost executors.

    by: a column by which the table is in buckets, as many as a shuffle has partitions, so that joins and
    groups on it don't shuffle the table again. stays: also when the ``scratch`` in which it is staged ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if _SCRATCH and not stays:
        _SCRATCH[-1].append(path)
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"staged_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog alone; the files stay
    return table


def by_part_of_keys(spark: SparkSession) -> SparkSession:
    """The session with settings of its own under which a join needs no shuffle where both sides are partitioned alike by some of its keys.

    For tables in buckets by a key by which they are folded anyway: what has one value of it meets in one task, joined or not. The given session keeps its settings.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def clear(spark: SparkSession) -> int:
    """Delete what this application has staged, once its results are written; gives the number of folders."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(_root(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith(f"{_PREFIX}{spark.sparkContext.applicationId}-")]
    for path in own:
        files.delete(path, True)
    return len(own)

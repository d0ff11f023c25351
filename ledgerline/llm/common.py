"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.storage import shared_dir, stage

__all__ = ["fresh", "shared_dir", "small_batches", "stage", "table"]

#: Rows of an Arrow batch: documents can be long, so a batch holds few of them.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named input table; only Spark opens the path, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column of an operator's own that none of a table's has, letter case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: few documents in an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

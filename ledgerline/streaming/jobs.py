"""Streaming jobs: ingest, short-horizon dedupe, live counters, classification loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.sources import envelopes as env
from ledgerline.storage import stage


def ingest_stream(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """New envelope files into the archive, each content once: the checkpoint is the cursor, the archive the memory.

    A batch that runs again finds its own rows in the archive and adds nothing; what can't be read is kept by batch.
    """
    lines = spark.readStream.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("line"))

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        good, bad = env.split_envelopes(batch)
        dated = env.with_keys(good).withColumn("year", F.coalesce(F.date_format("occurred_at", "yyyy"), F.lit("unknown")))
        keyed = stage(dated.withColumn("day", F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd"), F.lit("unknown"))))
        days = [r["day"] for r in keyed.select("day").distinct().collect()]  # those of one batch; they prune the archive
        try:
            archive = session.read.schema(keyed.schema).parquet(f"{out}/archive").filter(F.col("day").isin(days))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            archive = None
        # equal content has an equal key, in which its day is, so the other days need not be looked at
        env.write_once(archive, keyed).write.mode("append").partitionBy("year", "day", "source").parquet(f"{out}/archive")
        bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()


def dedupe(stream: DataFrame, keys: list[str], when: str, horizon: str = "1 hour") -> DataFrame:
    """Repeats within a horizon go; state older than that is dropped."""
    return stream.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, horizon).dropDuplicatesWithinWatermark(keys)


def live_counters(stream: DataFrame, when: str, by: str, width: str = "1 hour") -> DataFrame:
    """(start, by, n, total) of tumbling windows."""
    rows = stream.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, "1 day")
    return rows.groupBy(F.window(when, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and give its result as a table."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # a batch that runs again replaces what it wrote
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def classify_loop(backlog: Callable[[], DataFrame], classify: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame], None], most: int = 100) -> int:
    """Batches until the backlog is empty or one classifies nothing; each sees what the one before published. Returns the batches run."""
    for n in range(most):
        done = classify(backlog())
        if not done.limit(1).count():
            return n
        publish(done)
    return most


def classify_stream(stream: DataFrame, classify: Callable[[DataFrame, DataFrame | None], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch of new mail through ``classify(batch, known)``; known is what earlier batches published, null before the first.

    A batch that runs again sees what it saw the first time and replaces what it wrote.
    """

    def add(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.parquet(out).filter(F.col("batch") < number) if number else None
        classify(batch, known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()


def seen_ranges(stream: DataFrame, by: str, when: str) -> DataFrame:
    """(by, first_at, last_at, n) as mail arrives: ranges widen both ways and nothing is too late, so there is no watermark."""
    return stream.groupBy(by).agg(F.min(when).alias("first_at"), F.max(when).alias("last_at"), F.count(F.lit(1)).alias("n"))

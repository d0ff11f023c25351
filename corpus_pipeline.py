"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's docs.

Toxic documents go; of each group of near-duplicates one document stays; documents with benchmark passages
go; secrets are blanked out; the rest is mixed to the weights of its sources. All stages but the last return
the columns of documents; the last adds copies, the times that a document is taken, and leaves out documents
that are not taken at all. It has no SQL: a trained score and random rounding decide.

Defined results: a null text is clean, links with nothing, holds no secret and no benchmark passage, and has size
0, so the mix takes it 0 to 3 times without a word; a null identifier is a document of its own, compared and mixed
like others; of rows that repeat an identifier one stays; a null source is a source of its own; an empty table gives
an empty result; other columns go through unchanged, but for n_chars, which follows the text, and a column named
copies, which the mix replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, mixing, neardup, secrets, toxicity
from ledgerline.llm.common import fresh, small_batches, stage, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle and a similarity of 0.8."""
    small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an identifier get a number, so that each has its own copies."""
    small_batches(spark)
    key, other = "doc_id", fresh(docs, "__id")
    if not neardup.one_each(docs, key):
        key = fresh(docs, "__row")
        docs = stage(docs.withColumn(key, F.monotonically_increasing_id()))
    copies = mixing.mix_sources(docs, id_col=key).filter("copies > 0").select(F.col("doc_id").alias(other), "copies")
    mixed = docs.drop("copies").join(copies.hint("shuffle_hash"), F.col(key) == F.col(other)).drop(other)
    return mixed if key == "doc_id" else mixed.drop(key)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", blank_secrets), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

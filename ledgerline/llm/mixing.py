"""Mix sources to target weights by pivotal dependent rounding.

Every source gets a target number of words: the total of all sizes, shared by weight, stopped at
``cap`` times the source's own size, with the excess reshared by weight. A document of a source then
wants ``target / source size`` copies; the whole part is taken outright and the fractional part is
rounded by the pivotal method, in which two documents at a time trade probability, in proportion to
their sizes, until one of them is integral. Each trade keeps the expected and the actual words of the
pair, so a source misses its target by no more than the last undecided document.

The trades run in blocks of bounded size that are hashed out of each source, so a source with a third
of all rows is many blocks; every block leaves one undecided document at most, and the undecided ones
meet in a reduction tree whose fan-in is bounded.

Defined results: identifiers are whole numbers or text of their digits, and other text stops the job with Spark's
cast error; null text has size 0; a null source is a source of its own, ordered last; an empty
table gives an empty result; repeated rows count as rows of their own, in blocks of their own; sources whose sizes are all 0
have target 0. Reruns agree, because blocks, orders and draws all come from hashes of the rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Most rows of a first-level block, on average, and the number of blocks that meet in one node of the tree.
BLOCK_ROWS = 2_000
FAN_IN = 64
#: Repeated rows that one task numbers.
REPEATS = 100_000

WORDS = r"[^\x20\x09-\x0D]+"

_STATE = "doc_id long, source string, source_size long, target double, size long, copies long, part double, block long, open boolean"


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(source, source_size, n_docs, weight, target) from (source, size).

    Sources ordered by code point, null last, weigh 1, 2, 3, repeating. With the sources in order of
    cap * size / weight, the ones that stop at their cap come first; ``level`` is the words a unit of
    weight gets when the first k stop, and the right k is the first at which the next one doesn't.
    """
    by_source = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    named, _ = _ordered(by_source, [F.col("source").asc_nulls_last()], [])
    ranked = named.withColumn("weight", F.col("before_rows") % 3 + 1).drop("before_rows")
    ratio = F.col("source_size") / F.col("weight")
    rows, (size, weight) = _ordered(ranked, [ratio.asc(), F.col("source").asc_nulls_last()], ["source_size", "weight"])
    level = (F.lit(size) - cap * F.col("before_source_size")) / (F.lit(weight) - F.col("before_weight"))
    fits = rows.withColumn("level", level).filter(F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    chosen = fits.agg(F.min_by("level", "before_rows")).first()[0]
    return rows.select(
        "source", "source_size", "n_docs", "weight",
        F.coalesce(F.least(cap * F.col("source_size").cast("double"), F.lit(chosen).cast("double") * F.col("weight")), F.lit(0.0)).alias("target"),
    )


def _ordered(rows: DataFrame, order: list[Column], columns: list[str]) -> tuple[DataFrame, list[int]]:
    """rows with before_rows and the sums of columns before each in a global order, and the sums of all.

    Rows are dealt by ranges of the order, so that any number of sources lies in many tasks; what each range adds up to, a row for each task, says what the next ones begin with.
    """
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sums = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in columns]).orderBy("__part").collect()
    names, held, base = ["rows", *columns], [0] * (1 + len(columns)), []
    for r in sums:
        base.append((r["__part"], *held))
        held = [h + (r[n] or 0) for h, n in zip(held, names, strict=True)]
    starts = rows.sparkSession.createDataFrame(base, "__part long, " + ", ".join(f"__{n} long" for n in names))
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = {n: F.coalesce((F.count(F.lit(1)) if n == "rows" else F.sum(n)).over(own), F.lit(0)) for n in names}
    out = placed.join(starts, "__part").select(*rows.columns, *[(F.col(f"__{n}") + ahead[n]).alias(f"before_{n}") for n in names])
    return out, held[1:]


def _pivot(level: int, last: bool, seed: int):
    return lambda pdf: _trade(pdf, level, last, seed)


def _trade(pdf: pd.DataFrame, level: int, last: bool, seed: int) -> pd.DataFrame:
    """Trade within one block until one document at most is undecided; the last level draws for that one."""
    pdf = pdf.sort_values(["doc_id", "size", "copies", "part"], kind="stable", ignore_index=True)
    source = pdf["source"].iloc[0]
    name = 0 if pd.isna(source) else int.from_bytes(hashlib.sha256(str(source).encode("utf-8", "surrogatepass")).digest()[:16], "little")
    rng = np.random.default_rng([seed, level, name, int(pdf["block"].iloc[0])])
    size, part, copies = pdf["size"].to_numpy(np.float64), pdf["part"].to_numpy(np.float64).copy(), pdf["copies"].to_numpy(np.int64).copy()
    draws = rng.random(len(pdf))
    held, p = -1, 0.0
    for i in np.flatnonzero((size > 0) & (part > 1e-12)):
        if held < 0:
            held, p = i, part[i]
            continue
        a, b, q = size[held], size[i], part[i]
        up, down = min(1 - p, q * b / a), min(p, (1 - q) * b / a)
        # the first gains with the chance that keeps both expectations
        move = up if draws[i] * (up + down) < down else -down
        p, q = p + move, q - move * a / b
        if 1e-9 < p < 1 - 1e-9:
            copies[i] += round(q)
        else:
            copies[held] += round(p)
            held, p = (i, q) if 1e-9 < q < 1 - 1e-9 else (-1, 0.0)
            if held < 0:
                copies[i] += round(q)
    part[:] = 0.0
    still = np.zeros(len(pdf), bool)
    if held >= 0:
        if last:
            copies[held] += rng.random() < p
        else:
            part[held], still[held] = p, True
    return pdf.assign(copies=copies, part=part, open=still)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, seed: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) with one row for each row of docs.

    size is the number of words, taken the words the mix takes of the document, copies times size;
    copies is cap at most.
    """
    sizes = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"),
        )
    )
    # repeated rows are counted and then numbered, so that each of them has a place of its own
    counted = sizes.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("m"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / REPEATS))))
    parts = parts.repartition("doc_id", "h", "part") if (counted.agg(F.max("m")).first()[0] or 0) > REPEATS else parts
    last = F.least(F.col("m"), (F.col("part") + 1) * REPEATS) - 1
    each = parts.select("doc_id", "source", "size", F.explode(F.sequence(F.col("part") * REPEATS, last)).alias("k"), "h").withColumn("h", F.xxhash64("h", "k"))
    targets = source_targets(sizes, cap).withColumn("blocks", F.ceil(F.col("n_docs") / block_rows)).withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    first = each.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "source_size", "target", "size", F.least(F.floor(ratio), F.lit(cap)).cast("long").alias("copies"),
        F.greatest(ratio - F.floor(ratio), F.lit(0.0)).alias("part"), F.pmod("h", F.col("blocks")).cast("long").alias("block"), F.lit(False).alias("open"),
    )
    first = first.withColumn("part", F.when(F.col("copies") >= cap, F.lit(0.0)).otherwise(F.col("part")))
    most = targets.agg(F.max("blocks")).first()[0] or 1
    levels = 1 + math.ceil(round(math.log(most, FAN_IN), 9))
    done, now = [], first
    for level in range(levels):
        last = level == levels - 1
        now = stage(now.groupBy("source", "block").applyInPandas(_pivot(level, last, seed), _STATE))
        done.append(now.filter(~F.col("open")))
        now = now.filter("open").withColumn("block", F.floor(F.col("block") / FAN_IN)).withColumn("open", F.lit(False))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")

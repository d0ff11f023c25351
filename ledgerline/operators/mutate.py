"""Table changes as functions from old tables to new ones; a job reads a version and writes the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """table and the rows of new whose key it doesn't have; of several new rows with a key the first in order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [c for c in new.columns if c not in keys] or keys)))
    fresh = new.withColumn("_n", nth).filter("_n = 1").drop("_n").join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], least=(), greatest=(), keep=()) -> DataFrame:
    """One row a key: the least, greatest, or first present value of each column, old before new."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(new.select(*table.columns).withColumn("_new", F.lit(1)))
    aggs = [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in greatest]
    aggs += [F.min_by(c, F.struct(F.col(c).isNull(), "_new", c)).alias(c) for c in keep]
    return rows.groupBy(*keys).agg(*aggs).select(*table.columns)


def last_writer(table: DataFrame, new: DataFrame, keys: list[str], when: str) -> DataFrame:
    """One row a key, the newest; of rows of one time the new one."""
    rest = [c for c in table.columns if c not in keys]
    rows = table.withColumn("_new", F.lit(0)).unionByName(new.select(*table.columns).withColumn("_new", F.lit(1)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(when, "_new")).alias("_r")).select(*keys, "_r.*").select(*table.columns)


def remap(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace identifiers by a mapping (old, new)."""
    held = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return rows.join(held, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*rows.columns)


def merge_applications(applications: DataFrame, events: DataFrame, messages: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Applications, events and messages after merging ``old`` into ``new``.

    The target keeps its values and takes missing ones from its sources; of events that repeat stage and evidence one
    stays; offers at or after an acceptance go; sources go.
    """
    gone = mapping.select(F.col("old").alias("id"))
    fields = [c for c in applications.columns if c != "id"]
    grouped = applications.withColumn("_own", F.col("id")).join(mapping.select(F.col("old").alias("_own"), "new"), "_own", "left").withColumn("id", F.coalesce("new", "id"))
    merged = grouped.groupBy("id").agg(*[F.min_by(c, F.struct(F.col(c).isNull(), F.col("_own") != F.col("id"), F.col("_own"))).alias(c) for c in fields]).select(*applications.columns)
    merged = merged.join(gone, "id", "left_anti")
    moved = remap(events, "application_id", mapping)
    nth = F.row_number().over(Window.partitionBy("application_id", "stage", "evidence_message_id").orderBy("occurred_at", "id"))
    moved = moved.withColumn("_n", nth).filter("_n = 1").drop("_n")
    accepted = mapping.select(F.col("new").alias("application_id")).distinct().join(moved.filter("stage = 'accepted'").groupBy("application_id").agg(F.min("occurred_at").alias("_at")), "application_id")
    moved = moved.join(accepted, "application_id", "left").filter("_at IS NULL OR stage <> 'offer' OR occurred_at < _at").drop("_at").select(*events.columns)
    return merged, moved, remap(messages, "application_id", mapping)


def delete_companies(companies: DataFrame, applications: DataFrame, events: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All four tables without the companies in gone (id); their mail goes back to the backlog."""
    dead = applications.join(gone.select(F.col("id").alias("company_id")), "company_id", "left_semi").select(F.col("id").alias("application_id"))
    flagged = messages.join(gone.select(F.col("id").alias("company_id"), F.lit(True).alias("_gone")), "company_id", "left")
    clear = lambda c: F.when(F.col("_gone").isNull(), F.col(c)).alias(c)
    mail = flagged.select(*[clear(c) if c in ("company_id", "application_id", "classified_by") else F.col(c) for c in messages.columns])
    return (
        companies.join(gone.select("id"), "id", "left_anti"), applications.join(gone.select(F.col("id").alias("company_id")), "company_id", "left_anti").select(*applications.columns),
        events.join(dead, "application_id", "left_anti").select(*events.columns), mail,
    )


def reset_slice(messages: DataFrame, k: int, n: int) -> DataFrame:
    """Messages with the classification of slice k of n cleared; slices are disjoint and cover everything."""
    mine = F.pmod(F.xxhash64("id"), F.lit(n)) == k
    return messages.withColumn("classified_by", F.when(~mine, F.col("classified_by")))


def append_generation(applications: DataFrame, events: DataFrame, derived: DataFrame, answered: DataFrame, stamp) -> tuple[DataFrame, DataFrame]:
    """Events with a new generation, and applications stamped where a pass answered or wrote.

    derived: columns of events but derived_at; answered: application_id.
    """
    new = derived.withColumn("derived_at", F.lit(stamp))
    touched = answered.select("application_id").unionByName(derived.select("application_id")).distinct().select(F.col("application_id").alias("id"), F.lit(True).alias("_touched"))
    apps = applications.join(touched, "id", "left").withColumn("derived_at", F.when(F.col("_touched"), F.lit(stamp)).otherwise(F.col("derived_at"))).select(*applications.columns)
    return apps, events.unionByName(new.select(*events.columns))


def resolve_reviews(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """The queue with pending items of decided messages (message_id, status) closed."""
    held = decided.select("message_id", F.col("status").alias("_status"))
    return queue.join(held, "message_id", "left").withColumn("status", F.when((F.col("status") == "pending") & F.col("_status").isNotNull(), F.col("_status")).otherwise(F.col("status"))).select(*queue.columns)


def mark_negative(messages: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, links) after companies in gone (id) turned out not to matter: their mail is unlinked and marked, secondary links go."""
    flagged = messages.join(gone.select(F.col("id").alias("company_id"), F.lit(True).alias("_gone")), "company_id", "left")
    kept = F.col("_gone").isNull()
    mail = flagged.select(*[F.when(kept, F.col(c)).alias(c) if c in ("company_id", "application_id") else F.when(kept, F.col(c)).otherwise(F.lit("rule:negative")).alias(c) if c == "classified_by" else F.col(c) for c in messages.columns])
    return mail, links.join(gone.select(F.col("id").alias("company_id")), "company_id", "left_anti").select(*links.columns)


def apply_audit(messages: DataFrame, events: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, events) after an audit plan (id, action, target): links change, and what unlinked or moved mail evidenced goes."""
    held = plan.select("id", "action", F.col("target").alias("_target"))
    touched = F.col("action").isNotNull()
    rows = messages.join(held, "id", "left")
    mail = rows.select(*[F.when(F.col("action") == "relink", F.col("_target")).when(~touched | (F.col("action") != "unlink"), F.col(c)).alias(c) if c == "company_id" else F.when(~touched, F.col(c)).alias(c) if c == "application_id" else F.col(c) for c in messages.columns])
    return mail, events.join(plan.select(F.col("id").alias("evidence_message_id")), "evidence_message_id", "left_anti").select(*events.columns)


def record_conversations(conversations: DataFrame, applications: DataFrame, events: DataFrame, terminal: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(applications, events) after talks held off mail: a stage becomes an event of the generation that the application
    shows, and a final stage settles the outcome, forward in time only.

    conversations: id, application_id, occurred_at, stage.
    """
    told = conversations.filter("stage IS NOT NULL").join(applications.select(F.col("id").alias("application_id"), "derived_at"), "application_id")
    new = told.select(F.concat(F.lit("talk-"), "id").alias("id"), "application_id", "stage", "occurred_at", F.lit(None).cast("string").alias("evidence_message_id"), "derived_at")
    before = events.filter(F.col("stage").isin(*terminal)).groupBy("application_id").agg(F.max("occurred_at").alias("_ended"))
    last = told.filter(F.col("stage").isin(*terminal)).groupBy("application_id").agg(F.max_by(F.struct("stage", "occurred_at"), F.struct("occurred_at", "id")).alias("_t")).join(before, "application_id", "left")
    settled = last.filter(F.col("_ended").isNull() | (F.col("_t.occurred_at") >= F.col("_ended"))).select(F.col("application_id").alias("id"), F.col("_t.stage").alias("_outcome"))
    apps = applications.join(settled, "id", "left").withColumn("outcome", F.coalesce("_outcome", "outcome")).select(*applications.columns)
    return apps, events.unionByName(new.select(*events.columns))

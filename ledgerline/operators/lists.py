"""Company and message lists, their filters, home counts and the activity calendar."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .funnel import confirmed_rounds
from .scope import as_of, current_events, in_window, latest, latest_stage


def whose_turn(direction: Column) -> Column:
    return F.when(direction == "inbound", "your_turn").when(direction == "outbound", "their_turn").otherwise("none")


def classification_tag(by: Column) -> Column:
    """unclassified, prefilter, rule (learned rules and what is carried along threads) or model."""
    return F.when(by.isNull(), "unclassified").when(by.like("prefilter%"), "prefilter").when(by.like("rule%") | by.like("thread%"), "rule").otherwise("model")


def negative(message: DataFrame) -> Column:
    """No company, and classified by prefilter or rule; never null, so that unclassified mail is no negative."""
    return F.col("company_id").isNull() & F.coalesce(classification_tag(F.col("classified_by")).isin("prefilter", "rule"), F.lit(False))


def companies(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """One row a company: messages, applications, last touch, last direction and latest stage.

    Each branch is aggregated by itself; joining them first would multiply their rows. Mail is reduced by application first.
    """
    near = rec.message.groupBy("application_id", "company_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("sent_at", "id", "direction")).alias("r"))
    mail = near.groupBy("company_id").agg(F.sum("n").alias("message_count"), F.max("r").alias("r")).select("company_id", "message_count", F.col("r.sent_at").alias("last_touch"), F.col("r.direction").alias("last_direction"))
    apps = rec.application.groupBy("company_id").agg(F.count(F.lit(1)).alias("application_count"))
    stages = latest_stage(rec, "company_id").select("company_id", F.col("stage").alias("latest_stage"))
    base = in_window(rec.company, rec, since, until, message_key="company_id").withColumnRenamed("id", "company_id")
    rows = base.join(mail, "company_id", "left").join(apps, "company_id", "left").join(stages, "company_id", "left")
    return rows.fillna(0, ["message_count", "application_count"]).withColumn("turn", whose_turn(F.col("last_direction")))


def filter_companies(rows: DataFrame, at: datetime | None = None, search: str | None = None, kind: str | None = None, turn: str | None = None, substantive: bool = False, active_within_days: int | None = None) -> DataFrame:
    """Filters of the company list, over what ``companies`` gives."""
    if search:
        rows = rows.filter(F.col("canonical_name").ilike(f"%{search}%") | F.col("domain").ilike(f"%{search}%"))
    if kind in ("employer", "agency"):
        rows = rows.filter(F.col("kind") == kind)
    if turn in ("your_turn", "their_turn"):
        rows = rows.filter(F.col("turn") == turn)
    if substantive:
        rows = rows.filter("message_count >= 2 OR application_count >= 1")
    if active_within_days:
        rows = rows.filter(F.col("last_touch") >= F.lit(at - timedelta(days=active_within_days)))
    return rows


def page(rows: DataFrame, sort: str = "recency", limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of the company list, with the identifier against ties."""
    order = {"recency": F.desc_nulls_last("last_touch"), "activity": F.desc("message_count"), "name": F.asc("canonical_name")}.get(sort, F.desc_nulls_last("last_touch"))
    rows = rows.orderBy(order, "company_id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def messages(rec, strict_sql: bool = False, direction: str | None = None, tag: str | None = None, evidence: bool | None = None, hide_negative: bool = False, since: datetime | None = None, until: datetime | None = None, company: int | None = None, application: int | None = None, recorded: bool | None = None, within: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The message list with company, tag and the stages that each message is evidence of.

    within: tables of ids that messages must be in: the mail of a contact, hits of a search, mail that secondary links
    add to a company. recorded: whether a message has a company.

    strict_sql drops, with hide_negative, messages without company and class, as three-valued logic would.
    """
    stages = current_events(rec).filter("evidence_message_id IS NOT NULL").groupBy(F.col("evidence_message_id").alias("id")).agg(F.sort_array(F.collect_set("stage")).alias("stages"))
    rows = rec.message.withColumn("tag", classification_tag(F.col("classified_by")))
    if direction:
        rows = rows.filter(F.col("direction") == direction)
    if tag:
        rows = rows.filter(F.col("tag") == tag)
    if since is not None:
        rows = rows.filter(F.col("sent_at") >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.col("sent_at") <= F.lit(until))
    if company is not None:
        rows = rows.filter(F.col("company_id") == company)
    if application is not None:
        rows = rows.filter(F.col("application_id") == application)
    if recorded is not None:
        rows = rows.filter(F.col("company_id").isNotNull() == recorded)
    for ids in within:
        rows = rows.join(ids.select("id"), "id", "left_semi")
    if hide_negative:
        rows = rows.filter(~negative(rows))
        if strict_sql:
            rows = rows.filter("company_id IS NOT NULL OR classified_by IS NOT NULL")
    names = rec.company.select(F.col("id").alias("company_id"), "canonical_name")
    rows = rows.join(stages, "id", "left").join(names, "company_id", "left").withColumn("is_evidence", F.col("stages").isNotNull())
    if evidence is not None:
        rows = rows.filter(F.col("is_evidence") == evidence)
    return rows.select("id", "company_id", "canonical_name", "application_id", "direction", "sent_at", "tag", "is_evidence", F.array_join(F.coalesce("stages", F.array()), ",").alias("stages"))


def home_counts(rec) -> DataFrame:
    """One row of pipeline counts; classified means that classified_by is set."""
    queued = rec.review_queue.filter("status = 'pending'").select(F.col("message_id").alias("id")).distinct().withColumn("queued", F.lit(True))
    rows = rec.message.join(queued, "id", "left").withColumn("queued", F.coalesce("queued", F.lit(False)))
    done = F.col("classified_by").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~done).alias("unclassified"), F.count_if(F.col("classified_by") == "prefilter:negative").alias("negative"),
        F.count_if(done & F.col("company_id").isNotNull()).alias("recorded"),
        F.count_if(done & F.col("company_id").isNull() & (F.col("classified_by") != "prefilter:negative") & ~F.col("queued")).alias("not_job_related"),
        F.count_if("queued").alias("queued"),
    )


def daily_activity(rec, metric: str = "interviews", since: date | None = None, until: date | None = None, company_id: int | None = None) -> DataFrame:
    """(day, n): confirmed rounds, or inbound messages of companies."""
    rows = rec.message.filter("direction = 'inbound' AND company_id IS NOT NULL").select("company_id", F.col("sent_at").alias("d")) if metric == "messages" else confirmed_rounds(rec)
    if company_id is not None:
        rows = rows.filter(F.col("company_id") == company_id)
    day = F.to_date("d")
    if since is not None:
        rows = rows.filter(day >= F.lit(since))
    if until is not None:
        rows = rows.filter(day <= F.lit(until))
    return rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def activity_calendar(rec, until: date | None = None, since: date | None = None, days: int = 371, metric: str = "interviews") -> DataFrame:
    """(day, week, weekday, n, level): every day of a grid of Sunday-first weeks, at least ``days`` long.

    Levels begin at 1, 3, 6 and 11 events.
    """
    end = until or as_of(rec).date()
    start = min(since or end, end - timedelta(days=days - 1))
    grid = start - timedelta(days=(start.weekday() + 1) % 7)
    spark = rec.message.sparkSession
    dense = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    counts = daily_activity(rec, metric, start, end)
    n = F.coalesce("n", F.lit(0))
    level = F.when(n >= 11, 4).when(n >= 6, 3).when(n >= 3, 2).when(n >= 1, 1).otherwise(0)
    return dense.join(counts, "day", "left").select("day", F.floor(F.datediff("day", F.lit(grid)) / 7).cast("int").alias("week"), (F.dayofweek("day") - 1).alias("weekday"), n.alias("n"), level.alias("level"))


def verification_list(verifications: DataFrame) -> DataFrame:
    """The newest verification of each company, those found wrong first."""
    rows = latest(verifications, "company_id", "created_at", "id", "classification_correct")
    return rows.orderBy(F.asc_nulls_first("classification_correct"), F.desc("created_at"), "company_id")

"""Briefing lists: whose turn it is, what goes cold, offers and rejections."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.schemas import GHOSTED_AFTER, IN_FLIGHT, INTERVIEWS, OFFER_RANK, TERMINAL

from .funnel import application_facts
from .scope import as_of, between, current_events, in_window, last_message, latest_stage, whole_days


def _companies(rec) -> DataFrame:
    return rec.company.select(F.col("id").alias("company_id"), "canonical_name", "kind")


def awaiting_reply(rec, at: datetime | None = None, within_days: int | None = 120, limit: int | None = 25, include_terminal: bool = False, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Companies whose newest message is inbound, newest first, with the days of silence."""
    at = as_of(rec, at)
    rows = last_message(rec, "company_id").filter("direction = 'inbound'").filter(between(F.col("sent_at"), since, until))
    if within_days is not None:
        rows = rows.filter(F.col("sent_at") >= F.lit(at - timedelta(days=within_days)))
    rows = rows.join(_companies(rec), "company_id").join(latest_stage(rec, "company_id").select("company_id", "stage"), "company_id", "left")
    rows = rows.join(rec.application.select(F.col("id").alias("application_id"), "role_title"), "application_id", "left")
    if not include_terminal:
        rows = rows.filter(F.col("stage").isNull() | ~F.col("stage").isin(*TERMINAL))
    out = rows.select("company_id", "canonical_name", "kind", "application_id", "role_title", "stage", "sent_at", whole_days(at, F.col("sent_at")).alias("silent_days"))
    return out.orderBy(F.desc("sent_at"), "company_id").limit(limit) if limit is not None else out


def going_cold(rec, at: datetime | None = None, after_days: int = GHOSTED_AFTER, lead_days: int = 7, limit: int | None = 25) -> DataFrame:
    """Open applications about to be ghosted, the longest silence first."""
    at = as_of(rec, at)
    warn = max(after_days - lead_days, 0)
    rows = last_message(rec).filter("direction = 'outbound'").filter((F.col("sent_at") < F.lit(at - timedelta(days=warn))) & (F.col("sent_at") >= F.lit(at - timedelta(days=after_days))))
    apps = rec.application.filter("outcome IS NULL").select(F.col("id").alias("application_id"), "role_title")
    rows = rows.join(apps, "application_id").join(_companies(rec), "company_id").join(latest_stage(rec).select("application_id", "stage"), "application_id", "left")
    out = rows.filter(F.col("stage").isNull() | ~F.col("stage").isin(*TERMINAL)).select("company_id", "canonical_name", "kind", "application_id", "role_title", "stage", "sent_at", whole_days(at, F.col("sent_at")).alias("silent_days"))
    return out.orderBy("sent_at", "application_id").limit(limit) if limit is not None else out


def in_flight(rec, at: datetime | None = None, limit: int | None = 25) -> DataFrame:
    """Applications whose newest stage is mid-process and that have no outcome."""
    at = as_of(rec, at)
    apps = rec.application.filter("outcome IS NULL").select(F.col("id").alias("application_id"), "company_id", "role_title")
    rows = latest_stage(rec).filter(F.col("stage").isin(*IN_FLIGHT)).join(apps, "application_id").join(_companies(rec), "company_id")
    rows = rows.join(last_message(rec).select("application_id", "sent_at"), "application_id", "left")
    out = rows.select("company_id", "canonical_name", "kind", "application_id", "role_title", "stage", "sent_at", "occurred_at", whole_days(at, F.col("occurred_at")).alias("silent_days"))
    return out.orderBy(F.desc("occurred_at"), "application_id").limit(limit) if limit is not None else out


def offers(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """One row for each company, no agency, that made an offer: the application that came furthest.

    The status is the furthest point of the company; an answer whose evidence is an offer's own message is none.
    """
    events = current_events(rec)
    rank = F.array_position(F.array(*[F.lit(s) for s in OFFER_RANK]), F.col("stage"))
    by_app = events.groupBy("application_id", "company_id").agg(
        F.max(rank).alias("peak"), F.bool_or(F.col("stage") == "offer").alias("offer"),
        F.bool_or(F.col("stage").isin("accepted", "declined")).alias("answer"), F.bool_or(F.col("stage").isin(*INTERVIEWS)).alias("met"),
    )
    offered = by_app.filter("offer OR (answer AND met)").select("application_id", "company_id", "peak")
    evidence = events.filter("stage = 'offer' AND evidence_message_id IS NOT NULL").select(F.col("evidence_message_id").alias("_e")).distinct()
    answers = events.filter(F.col("stage").isin("accepted", "declined"))
    answers = answers.join(evidence, F.col("evidence_message_id") == F.col("_e"), "left_anti")
    status = events.filter("stage = 'offer'").unionByName(answers).groupBy("company_id").agg(F.max_by("stage", rank).alias("company_stage"))
    apps = in_window(rec.application, rec, since, until).select(F.col("id").alias("application_id"), "role_title")
    rows = offered.join(apps, "application_id").join(_companies(rec).filter("kind <> 'agency'"), "company_id")
    rows = rows.join(latest_stage(rec), "application_id", "left").join(last_message(rec).select("application_id", "sent_at"), "application_id", "left")
    # the furthest first, then titled, then the earliest, then the smallest number
    best = F.struct(-F.col("peak"), F.col("role_title").isNull(), F.coalesce("occurred_at", F.lit("9999-12-31").cast("timestamp_ntz")), "application_id")
    keep = rows.groupBy("company_id").agg(F.min_by(F.struct("canonical_name", "kind", "application_id", "role_title", "stage", "occurred_at", "sent_at"), best).alias("r"))
    return keep.join(status, "company_id", "left").select("company_id", "r.canonical_name", "r.kind", "r.application_id", "r.role_title", F.coalesce("company_stage", "r.stage").alias("status"), "r.sent_at")


def rejections(rec, limit: int | None = 200, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Applications that a company, no agency, said no to, the newest stage first."""
    facts = application_facts(rec, since, until).filter("outcome = 'rejected'")
    evented = current_events(rec).filter("stage IN ('offer', 'accepted', 'rejected', 'withdrawn', 'declined')").select("application_id").distinct()
    rows = facts.join(evented, "application_id", "left_semi").select("application_id", "company_id")
    rows = rows.join(_companies(rec).filter("kind <> 'agency'"), "company_id").join(latest_stage(rec), "application_id", "left")
    out = rows.select("company_id", "canonical_name", "application_id", "stage", "occurred_at")
    return out.orderBy(F.desc_nulls_last("occurred_at"), "application_id").limit(limit) if limit is not None else out

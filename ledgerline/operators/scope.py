"""Views that the analytic operators share: the generation an application shows, its window, and what is latest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.schemas import TERMINAL


def as_of(rec, at: datetime | None = None) -> datetime:
    """The present of a report: given, or the time of the newest message."""
    return at or rec.message.agg(F.max("sent_at")).first()[0]


def between(when: Column, since: datetime | None, until: datetime | None) -> Column:
    """Both ends inclusive; a missing bound bounds nothing."""
    out = F.lit(True)
    if since is not None:
        out = out & (when >= F.lit(since))
    if until is not None:
        out = out & (when <= F.lit(until))
    return out


def in_window(apps: DataFrame, rec, since: datetime | None = None, until: datetime | None = None, key: str = "id", message_key: str = "application_id") -> DataFrame:
    """The rows that exchanged mail in the range; all rows, without a join, if the range is open."""
    if since is None and until is None:
        return apps
    mail = rec.message.filter(between(F.col("sent_at"), since, until)).select(F.col(message_key).alias("_key")).distinct()
    return apps.join(mail, apps[key] == F.col("_key"), "left_semi")


def current_events(rec) -> DataFrame:
    """Stage events of the generation that their application shows, with the application's company.

    An application that no derivation has reached shows its unstamped events.
    """
    apps = rec.application.select(F.col("id").alias("application_id"), "company_id", F.col("derived_at").alias("_shown"))
    # <=> would become a key of the join, and its rows would lie by generation too: what groups them by application would shuffle them again
    shown = F.expr("coalesce(derived_at = _shown, derived_at IS NULL AND _shown IS NULL)")
    return rec.stage_event.join(apps, "application_id").filter(shown).drop("_shown", "derived_at")


def latest(rows: DataFrame, key: str, when: str, *fields: str, tie: str = "id", within: str | None = None) -> DataFrame:
    """The fields of the newest row of each key; ties go to the largest ``tie``. Rows without a time are left out.

    An aggregate, so that the rows of a key are reduced before they are shuffled. within: a finer key on which the rows were
    joined; they are reduced by it where they lie, and only what is left of them is shuffled by key.
    """
    rows = rows.filter(F.col(when).isNotNull() & F.col(key).isNotNull())
    if within is not None:
        kept = [c for c in dict.fromkeys((when, tie, *fields)) if c != within]
        rows = rows.groupBy(within, key).agg(F.max(F.struct(*kept)).alias("_near")).select(within, key, "_near.*")
    # the greatest of one struct and not max_by, which would carry time and tie twice
    top = rows.groupBy(key).agg(F.max(F.struct(*dict.fromkeys((when, tie, *fields)))).alias("_top"))
    return top.select(key, *[F.col(f"_top.{c}") for c in dict.fromkeys((*fields, when))])


def latest_stage(rec, key: str = "application_id") -> DataFrame:
    """(key, stage, occurred_at) of the newest current event."""
    return latest(current_events(rec), key, "occurred_at", "stage", within="application_id" if key == "company_id" else None)


def last_message(rec, key: str = "application_id") -> DataFrame:
    """(key, direction, sent_at, and the other key) of the newest message."""
    other = "company_id" if key == "application_id" else "application_id"
    return latest(rec.message, key, "sent_at", "direction", other, within="application_id" if key == "company_id" else None)


def whole_days(later, earlier: Column) -> Column:
    """Elapsed days, not midnights between."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((seconds(F.lit(later) if isinstance(later, datetime) else later) - seconds(earlier)) / 86_400_000_000).cast("int")


def ghosted(last_out: Column, direction: Column, stage: Column, at: datetime, after_days: int = 21) -> Column:
    """Silence after an outbound message for more than ``after_days`` whole days, without an ending."""
    ended = F.coalesce(stage.isin(*TERMINAL), F.lit(False))
    return F.coalesce((direction == "outbound") & ~ended & (whole_days(at, last_out) > after_days), F.lit(False))
